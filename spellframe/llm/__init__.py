"""Operators for preparing training text: deduplication, screening, extraction, tokenising."""
