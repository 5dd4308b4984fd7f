"""Column functions: no shuffle, no Python worker, usable on batch and streaming frames alike."""
