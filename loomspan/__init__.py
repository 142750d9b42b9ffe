"""loomspan: a PySpark-native engine for source-code health and relational analysis."""
