"""Operators of a training-data pipeline: sharding, classifiers, formatting, fingerprints, packing, scoring."""
