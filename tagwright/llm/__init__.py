"""Operators of a training-data pipeline: quality, search, privacy, extraction,
packing, deduplication, language, mixing and token counts.

Nothing outside this subpackage imports it; ``llm/queries.py`` registers one
query per operator and ``corpus_pipeline.py`` chains five of them.
"""
