"""Operators of a training-data pipeline: ten independent components on documents, vectors and conversations."""
