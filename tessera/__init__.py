"""tessera: a PySpark-native governed retrieval, evaluation and operations-analytics library."""
