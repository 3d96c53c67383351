"""Spark-native analytics for annotated loci in large sequence collections."""
