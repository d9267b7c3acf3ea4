"""Scoring and monitoring of streams."""
