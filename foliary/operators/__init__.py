"""Relational operators: merge, queues, history, aggregates, windows."""
