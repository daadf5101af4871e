"""Training-data operators: deduplication, filtering, packing, counting, search.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
