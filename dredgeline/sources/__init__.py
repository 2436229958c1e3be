"""Readers of files and logical relations, and writers of reports."""
