"""lexloom: a Spark-native engine for building and analysing text corpora."""

__version__ = "0.1.0"
