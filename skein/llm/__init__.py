"""Training-data operators: mixing, deduplication, search, packing, scoring, scanning.

Each module holds one operator with a general interface; ``queries`` derives the
fixed digest columns from them.  Nothing outside this subpackage imports it.
"""
