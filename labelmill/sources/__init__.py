"""Readers that give every record its position as a column."""
