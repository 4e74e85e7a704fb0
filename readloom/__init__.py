"""Spark-native analytics over sequencing reads, alignments and variants."""
