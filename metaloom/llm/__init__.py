"""Operators for training-data pipelines of language models. Nothing else in the library imports this."""
