"""Every query of this package with its SQL, for the driver's entry points."""

from __future__ import annotations

from quantframe.llm import queries_corpus, queries_select, queries_text

QUERIES = {**queries_corpus.QUERIES, **queries_text.QUERIES, **queries_select.QUERIES}
ORACLES = {**queries_corpus.ORACLES, **queries_text.ORACLES, **queries_select.ORACLES}
