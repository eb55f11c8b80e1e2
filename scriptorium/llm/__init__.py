"""Training-data operators: deduplication, packing, mixing, media, tokens, scoring.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries are in :mod:`scriptorium.llm.queries`.
"""
