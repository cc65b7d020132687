"""Sources: repository files, symbols, change feeds, traces."""
