"""Operators for training-data pipelines.  Nothing else in corvid imports this subpackage."""
