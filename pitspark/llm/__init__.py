"""Training-data operators: dedup, filtering, tokenizing, packing and sharding of text corpora.

Nothing outside this subpackage imports it.
"""
