"""User-visible results: each function takes facts and dimensions and returns one DataFrame."""
