"""Training-data operators: deduplication, quality, scoring, packing, extraction, secrets, tokens.

Nothing else in the library imports this package. Each module is one operator; ``queries`` registers
the ``opN_<name>`` queries and their SQL.
"""
