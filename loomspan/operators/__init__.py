"""loomspan.operators."""
