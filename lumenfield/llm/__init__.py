"""Training-data operators: tokens, near-duplicates, mixing, media, secrets, archives, vectors, languages.

Nothing outside this subpackage imports it.  Each module holds one operator with its general interface;
`queries` holds the thin production queries built on them.
"""
