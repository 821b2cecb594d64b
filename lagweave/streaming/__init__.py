"""Structured Streaming versions of the adaptive estimators."""
