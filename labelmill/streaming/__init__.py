"""Incremental runs of the stateless column functions."""
