"""Operators of the review-integrity engine."""
