"""Files, the index catalog, row reads and the cache."""
