"""Operators of a training-data pipeline: one module each, one registered query each."""
