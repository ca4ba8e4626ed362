"""lodestone: a PySpark-native hybrid retrieval and corpus-processing engine."""
