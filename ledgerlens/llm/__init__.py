"""Operators of a large-scale training-data pipeline (language ID, chat
formatting, deduplication, tokenisation, sharding, decontamination).

Nothing outside this subpackage imports it; ``queries`` registers one query
per operator and ``corpus_pipeline.py`` chains five of them."""
