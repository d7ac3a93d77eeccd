"""Training-data operators: language id, URL filter, BPE, near and exact dedup,
toxicity, personal data, licences, packing and quality rules.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
