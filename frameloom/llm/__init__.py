"""Training-data operators: dedup, archives, personal data, scoring, tokens, filters.

Each module holds one operator behind a general interface; ``queries`` holds the
thin registered queries that fix table, parameters and digest columns.
"""
