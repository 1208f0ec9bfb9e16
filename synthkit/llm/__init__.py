"""Operators for training-data pipelines: filters, fingerprints, dedup, decontamination, sharding, packing.

Nothing else in the library imports this package.
"""
