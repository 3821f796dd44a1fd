"""Queries bound to the standard tables, each with the SQL it equals."""
