"""Readers and writers around the fact log."""
