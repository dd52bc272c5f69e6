"""Cohort analytics on Spark: build a cohort, attach windowed features, audit it, score it."""
