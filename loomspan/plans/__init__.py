"""loomspan.plans."""
