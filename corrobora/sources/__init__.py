"""Readers, register mapping and writers."""
