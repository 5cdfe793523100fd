"""Paged-document assembly and training-data preparation on Spark."""
