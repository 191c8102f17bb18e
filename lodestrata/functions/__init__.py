"""functions of lodestrata."""
