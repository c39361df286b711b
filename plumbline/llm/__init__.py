"""Training-data operators: formatting, filtering, deduplication, scoring and packing of text corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
