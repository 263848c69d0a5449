"""Readers and writers with explicit schemas, and document-format table functions."""
