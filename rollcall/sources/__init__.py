"""Readers that bring inconsistent sources into raw records."""
