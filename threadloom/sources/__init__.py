"""Readers, table merges and writers."""
