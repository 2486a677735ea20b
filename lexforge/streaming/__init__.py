"""Incremental postings: shards are indexed as they arrive."""
