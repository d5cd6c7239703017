"""Training-data operators: dedup, tokenisation, packing, scans, search and scoring.

Nothing outside this subpackage imports it.
"""
