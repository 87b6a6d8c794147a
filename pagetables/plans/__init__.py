"""Input views and the registry of queries with their SQL checks."""
