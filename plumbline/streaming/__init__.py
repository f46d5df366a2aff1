"""Streaming of the review-integrity engine."""
