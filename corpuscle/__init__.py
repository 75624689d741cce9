"""A PySpark-native engine for analysing corpora of long-form text."""
