"""All registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from judgealign.llm import q_corpus, q_rules

QUERIES = {**q_rules.QUERIES, **q_corpus.QUERIES}
ORACLES = {**q_rules.ORACLES, **q_corpus.ORACLES}
