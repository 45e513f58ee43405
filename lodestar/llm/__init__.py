"""Training-data operators: near-duplicate join, archives, search, packing, extraction, scans, mixing, language ID.

Nothing else in the library imports this subpackage.
"""
