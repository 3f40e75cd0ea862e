"""kinspark: a PySpark-native engine for comparative genomics on similarity graphs."""
