"""Operators for training-data pipelines, each a function from DataFrame to DataFrame."""
