"""quarry: a PySpark-native engine for deduplicating, linking and comparing collections."""
