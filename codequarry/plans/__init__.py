"""Whole queries put together from operators and sources."""
