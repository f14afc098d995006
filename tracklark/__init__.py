"""Spark-first analytics over positional time series, with an optional subpackage for training-data pipelines."""
