"""Spark-native analytics over ensembles of overlapping groupings."""
