"""Ordered, versioned key-value data on Spark, with operators for training-data pipelines beside it."""
