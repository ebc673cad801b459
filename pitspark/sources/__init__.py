"""Readers of landed files and writers of result tables."""
