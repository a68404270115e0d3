"""sluice: a Spark-native engine for multi-source metrics and corpora."""
