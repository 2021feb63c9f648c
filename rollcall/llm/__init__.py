"""Training-data operators: archives, language, packing, tokenisation, quality, search and near-duplicates.

Nothing outside this subpackage imports it.
"""
