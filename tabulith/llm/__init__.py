"""Training-data operators: extraction, licences, dedup, tokens, packing, search.

Nothing outside this subpackage imports it.
"""
