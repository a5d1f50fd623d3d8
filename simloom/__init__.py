"""Similarity analytics expressed as Spark DataFrame plans."""
