"""Training-data operators: scoring, tokens, fingerprints, filters, mixing, packing, formatting.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
