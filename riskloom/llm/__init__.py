"""Operators of training-data pipelines over text, vector, page and conversation tables."""
