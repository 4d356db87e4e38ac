"""Operators for preparing language-model training data.

Nothing outside this folder imports it; ``queries`` registers one query for each
operator, and ``corpus_pipeline.py`` chains five of them.
"""
