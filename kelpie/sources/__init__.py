"""Readers and writers of vector tables, manifests and reports."""
