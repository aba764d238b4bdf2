"""Operators for preparing training text: deduplication, classification, tokenizing and packing."""
