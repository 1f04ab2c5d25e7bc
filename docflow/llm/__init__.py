"""Operators that prepare training data: filters, dedup, tokens, packing, sharding.

Every operator takes and returns DataFrames; ``queries`` holds the thin
registered queries and their SQL twins.
"""
