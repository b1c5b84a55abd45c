"""loomspan.functions."""
