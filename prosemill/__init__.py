"""A Spark-native engine for text corpora and lexical substitution."""
