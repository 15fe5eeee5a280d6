"""Coded-text analytics on Spark: chunking, annotation repair, factor memories, classification and rule checks."""
