"""Column functions: text, hashing, vectors, time."""
