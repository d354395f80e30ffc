"""Training-data operators on Spark: packing, mixing, search, filters, dedup.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
