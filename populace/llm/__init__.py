"""Training-data operators: dedup, packing, tokenization, quality, extraction.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
