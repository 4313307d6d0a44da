"""Readers of tables, files, commits and reports."""
