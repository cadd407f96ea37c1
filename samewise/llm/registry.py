"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from samewise.llm import address, encode, garbled, linkage, mixture, topn, variants, visual

MODULES = [topn, visual, linkage, address, variants, encode, mixture, garbled]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
