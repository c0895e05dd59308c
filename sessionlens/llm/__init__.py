"""Operators for preparing text corpora: search, filtering, de-duplication, archives, mixing."""
