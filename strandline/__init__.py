"""Strandline: Spark-native storage, cleaning and hybrid retrieval of short text records."""
