"""All registered queries and their SQL twins."""

from __future__ import annotations

from judgealign.plans import q_align, q_corpus, q_files, q_more, q_stream, q_text

_MODULES = [q_align, q_text, q_corpus, q_more, q_stream, q_files]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}
