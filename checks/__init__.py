"""The library's operators applied to the driver tables, and the same results in SQL."""
