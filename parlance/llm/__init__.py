"""Training-data operators: dedup, quality, privacy, mixing, sharding, tokens.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
