"""tamiz: a Spark-native text retrieval and text-data engine."""
