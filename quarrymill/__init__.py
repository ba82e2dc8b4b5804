"""Spark jobs that audit corpora of smart-contract sources."""
