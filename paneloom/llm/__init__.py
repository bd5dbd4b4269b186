"""Preparation of training data: mixing, line and document deduplication, extraction, scans, rules, sharding, pieces.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query for each operator.
"""
