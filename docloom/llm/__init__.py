"""Training-data operators: extraction, curation, deduplication, packing and formatting.

Nothing outside this subpackage imports it; ``queries`` registers one query for each operator.
"""
