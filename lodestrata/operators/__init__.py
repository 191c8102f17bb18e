"""operators of lodestrata."""
