"""Training-data operators: URL filters, scoring, joins, search, mixing, secrets, archives.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
