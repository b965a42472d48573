"""Training-data operators: quality, sharding, filtering, de-duplication and tokenising at corpus scale.

Nothing outside this subpackage imports it; ``queries`` registers its entries.
"""
