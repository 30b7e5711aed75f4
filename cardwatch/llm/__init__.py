"""Operators for training-data pipelines: text in documents, conversations and pages."""
