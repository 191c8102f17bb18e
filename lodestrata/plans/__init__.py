"""plans of lodestrata."""
