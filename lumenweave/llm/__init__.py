"""Operators for preparing language-model training corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
