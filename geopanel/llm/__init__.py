"""Training-data operators: scoring, mixing, sharding, filtering, extraction, packing, deduplication and search.

Nothing outside this subpackage imports it. Each module holds one operator with its own general interface;
``queries`` binds the operators to the driver's tables.
"""
