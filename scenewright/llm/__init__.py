"""Training-data operators: quality, secrets, duplicates, tokens, licences, mixing, leaks and archives.

Nothing else in the package imports this subpackage.
"""
