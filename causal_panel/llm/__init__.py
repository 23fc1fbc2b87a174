"""Operators for preparing text corpora: cleaning, deduplication, scans, formatting, mixing and packing."""
