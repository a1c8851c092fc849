"""Training-data operators: sharding, extraction, rules, scans, joins, packing.

Each module is one operator with a general interface; ``queries`` holds the
thin registered queries.  Nothing else in the library imports this package.
"""
