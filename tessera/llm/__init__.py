"""Operators for preparing training text: sharding, scoring, tokenising, filtering and deduplication."""
