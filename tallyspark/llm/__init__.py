"""Operators for large-scale training-data pipelines (each module is one operator)."""
