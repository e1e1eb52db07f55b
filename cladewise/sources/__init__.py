"""Readers and writers of trees, alignments, tables and traces."""
