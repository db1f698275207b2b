"""A Spark-native engine for single-cell multi-omics tables."""
