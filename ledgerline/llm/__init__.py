"""Training-data operators: quality rules, deduplication, extraction, scans,
tokenisation, language-model scoring, mixing, decontamination, collocations and
spelling variants.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; ``queries`` registers the thin queries.
"""
