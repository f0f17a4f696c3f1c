"""Operators that prepare training data: packing, deduplication, tokens, language, toxicity, personal data, search.

Every operator is a Spark job over DataFrames; ``queries`` registers one query for each. Nothing outside this folder,
``corpus_pipeline.py`` and ``__spark_entry__.py`` imports it.
"""
