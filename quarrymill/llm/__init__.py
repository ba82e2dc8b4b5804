"""Operators that prepare text corpora for training: dedup, filters, mixing, scans.

Nothing outside this subpackage imports it.
"""
