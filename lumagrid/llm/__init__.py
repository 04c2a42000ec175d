"""Training-data operators: one module each, and ``registry`` for their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
