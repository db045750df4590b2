"""Operators that prepare training corpora: packing, mixing, near duplicates, token files, filters and search.

Nothing else in the library imports this subpackage.  ``queries.py`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
