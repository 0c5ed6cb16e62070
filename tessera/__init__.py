"""A Spark-native engine for tables that mix ordinary columns with vectors."""
