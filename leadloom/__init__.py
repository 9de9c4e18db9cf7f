"""Spark-native engine for entity-centric lead research: DataFrame and SQL operators."""
