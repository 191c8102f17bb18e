"""sources of lodestrata."""
