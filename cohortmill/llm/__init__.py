"""Operators of a training-data pipeline: screening, joins, search, mixing and sharding of text corpora."""
