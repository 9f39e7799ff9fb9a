"""Training-data operators: deduplication, filtering, scoring, mixing and tokenising of document tables.

Nothing outside this subpackage imports it.
"""
