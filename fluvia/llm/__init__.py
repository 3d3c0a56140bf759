"""Training-data operators: text scans, deduplication, tokenisation, packing.

Nothing else in the library imports this subpackage.
"""
