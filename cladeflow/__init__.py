"""Spark-native analytics for single-cell host-microbiome sequencing data."""
