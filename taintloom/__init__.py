"""A Spark-native engine for relational analysis of source code and text."""
