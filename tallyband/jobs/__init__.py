"""Registered report queries over the relational tables, each with its SQL."""
