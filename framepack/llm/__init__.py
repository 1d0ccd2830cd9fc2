"""Operators for preparing text corpora: quality rules, licences, personal data, secrets, tokens, packing and near-duplicates.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
