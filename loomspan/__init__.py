"""loomspan: learning-data and text-corpus analytics expressed as Spark plans."""
