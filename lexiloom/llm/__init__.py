"""Training-data operators (dedup, extraction, tokenisation, scoring, packing).

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
