"""streaming of lodestrata."""
