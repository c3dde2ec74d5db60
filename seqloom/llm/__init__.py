"""Training-data operators: tokenisation, quality, privacy, packing, deduplication, licences.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
