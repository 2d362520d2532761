"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import fill_in_middle, host_rules, huffman, language, licences, mixing, near_dup, neighbours, packing, passages, quality, spelling, toxicity

MODULES = (packing, huffman, toxicity, language, passages, near_dup, mixing, host_rules, licences, neighbours, fill_in_middle, spelling, quality)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
