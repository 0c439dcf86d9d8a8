"""gavelspark: a PySpark-native engine for claim-verification datasets."""
