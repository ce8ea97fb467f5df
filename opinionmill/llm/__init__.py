"""Operators for training-data pipelines: deduplication, filters, scans, packing and chat rendering.

Nothing else in the library imports this subpackage.
"""
