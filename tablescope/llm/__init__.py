"""Operators for training-data pipelines; their queries are registered in ``queries.py``."""
