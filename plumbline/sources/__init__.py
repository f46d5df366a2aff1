"""Sources of the review-integrity engine."""
