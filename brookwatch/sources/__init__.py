"""Readers and writers of flow tables, lists, patterns and exports."""
