"""All queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import queries_chat, queries_corpus, queries_models, queries_vectors

_ALL = (queries_chat, queries_corpus, queries_models, queries_vectors)
QUERIES = {name: q for m in _ALL for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _ALL for name, q in m.ORACLES.items()}
