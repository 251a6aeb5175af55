"""Operators that prepare text for training: sharding, dedup, scoring, tokens, search and mixing."""
