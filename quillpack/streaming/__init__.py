"""Encoders over unbounded input."""
