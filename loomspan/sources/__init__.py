"""loomspan.sources."""
