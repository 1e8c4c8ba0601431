"""Operators for preparing training text: sharding, fixity, filters, deduplication, encoding."""
