"""Readers of other layouts than tables: trees of comments as JSON, and files of JSON lines."""
