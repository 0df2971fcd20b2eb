"""Operators for preparing training text: mixing, deduplication, formatting, encoding and labelling."""
