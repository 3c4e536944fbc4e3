"""Sylvan: querying corpora of HTML (and other documents) with plain Spark plans."""
