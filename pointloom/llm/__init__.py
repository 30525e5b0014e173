"""Operators for preparing training corpora: search, deduplication, extraction, scoring, mixing and tokens."""
