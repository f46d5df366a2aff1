"""Functions of the review-integrity engine."""
