"""Readers, writers and derived test data."""
