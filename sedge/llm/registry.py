"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, language, mixing, multi_index, ngram_join, postings, quotes, secrets, toxicity, warc

MODULES = (bpe, language, mixing, multi_index, ngram_join, postings, quotes, secrets, toxicity, warc)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
