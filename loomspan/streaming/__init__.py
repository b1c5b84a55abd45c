"""loomspan.streaming."""
