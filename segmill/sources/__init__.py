"""Readers and writers. Schemas are given, never inferred."""
