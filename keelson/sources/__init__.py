"""Readers and stored datasets."""
