"""Readers and writers: delimited text, files, declared tables, JSON lines."""
