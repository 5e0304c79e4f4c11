"""Training-data pipeline operators: deduplication, joins, language ID, archives, mixing, tokenising.

Each operator lives in its own module with a general interface; ``queries`` registers the thin
``opN_*`` queries over the standard tables.  Nothing outside this subpackage imports it.
"""
