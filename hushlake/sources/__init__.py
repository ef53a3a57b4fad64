"""Readers and writers: dialog files, metric tables, settings."""
