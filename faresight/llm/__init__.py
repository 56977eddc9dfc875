"""Operators of a training-data pipeline: near-duplicate joins, fingerprints, packing, repeated-span
removal, mixing, license and secret scans, language identification, sharding and quality rules."""
