"""All queries of the core and their SQL."""

from __future__ import annotations

from samewise.plans import decoding, flow, heavy, learning, pairs, texts

MODULES = [flow, heavy, decoding, texts, pairs, learning]
FLAGSHIP = "fl_link"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
