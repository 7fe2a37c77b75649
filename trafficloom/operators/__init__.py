"""Queries and transformations on event and roll-up tables."""
