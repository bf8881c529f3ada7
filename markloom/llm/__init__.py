"""Training-data operators: dedup, mixing, packing, language, secrets, search and URL rules.

Nothing outside this subpackage imports it.
"""
