"""Operators for training-data pipelines over documents and pages; queries are in ``queries``."""
