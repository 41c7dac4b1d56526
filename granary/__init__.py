"""Corpus analytics on Spark: text, structure, change and cost computations as DataFrame operators."""
