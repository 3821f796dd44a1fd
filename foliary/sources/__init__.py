"""Readers and parsers that turn files and markup into relations."""
