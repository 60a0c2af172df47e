"""skeinspark: a PySpark-native analytics library."""
