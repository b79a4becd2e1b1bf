"""Readers for repository files and JSON evidence."""
