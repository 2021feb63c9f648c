"""Operators over raw records: blocking, scoring, clustering, merging, confidence and output."""
