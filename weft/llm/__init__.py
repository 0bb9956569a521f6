"""Training-data operators: deduplication, tokenised output, search, extraction, mixing, repeats.

Nothing outside this package imports it.  ``queries.py`` holds the registered queries and
their SQL; ``corpus_pipeline.py`` at the repository top chains five of the operators.
"""
