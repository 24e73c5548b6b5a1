"""Readers that turn files and tables into memory chunks."""
