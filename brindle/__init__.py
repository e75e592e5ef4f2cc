"""Spark-first engine for activation-explanation datasets."""
