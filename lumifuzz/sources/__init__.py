"""Readers and writers of tables, rule texts and partition texts."""
