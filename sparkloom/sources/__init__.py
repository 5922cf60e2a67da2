"""Model files, rank files and their tables."""
