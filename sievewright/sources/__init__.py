"""Readers and writers of manifests, keyed text, block tables and file inventories."""
