"""Readers, writers and shared intermediate storage."""
