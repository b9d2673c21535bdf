"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fusemill.llm import fmindex, graph, leximin, minhash, mixing, sentences, suffixes, topn

_MODULES = (topn, leximin, minhash, suffixes, graph, fmindex, mixing, sentences)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
