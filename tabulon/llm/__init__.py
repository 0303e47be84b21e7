"""Operators of a training-data pipeline: de-duplication, filters, scoring and packing.

Nothing outside this subpackage imports it.  Its queries are in ``queries.py``.
"""
