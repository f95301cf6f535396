"""Training-data operators: token counts, extraction, dedup, packing and so on.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it."""
