"""Operators for preparing language-model training data.

Each module holds one operator on DataFrames.  ``queries`` binds them to the
driver's tables; ``common`` holds what they share.  Nothing outside this
subpackage imports it.
"""
