"""Detectors and relational operators over documents, lines and findings."""
