"""Structured Streaming wrappers and event folds."""
