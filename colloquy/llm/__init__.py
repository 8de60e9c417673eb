"""Training-data operators: search, tokenizing, formatting, quality, dedup and filters.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
