"""Readers and writers for documents, reports and record tables."""
