"""Spark-native analytics of image time-series: lanes, labelled regions, lineages and per-region series."""
