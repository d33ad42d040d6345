"""Whole runs: from articles to described themes."""
