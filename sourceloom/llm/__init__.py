"""Operators of a training-data pipeline: scans, deduplication, scoring, packing, formatting.

Nothing outside this subpackage imports it.
"""
