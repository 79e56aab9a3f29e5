"""Query catalog: every registered query as a Spark builder plus its SQL twin."""

from __future__ import annotations

import importlib

MODULES = ["q_terms", "q_authors", "q_clean", "q_vectors", "q_graph", "q_models", "q_stream", "q_sources", "q_extra", "q_scoring", "q_similar"]


def all_queries():
    out = {}
    for m in MODULES:
        mod = importlib.import_module(f"{__name__}.{m}")
        for q in mod.QUERIES:
            if q.name in out:
                raise ValueError(f"duplicate query {q.name}")
            out[q.name] = q
    return out
