"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import evaluation, flows, graphs, lexicon, questions, vectors

MODULES = (vectors, lexicon, graphs, evaluation, questions, flows)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
