"""Every named query of the library and its SQL equivalent."""

from __future__ import annotations

from chorale.plans import core, exchange, inflections, kinds, learned, mirrors, relations, selection, series, streamed, words

_PARTS = (core, relations, words, exchange, series, learned, selection, streamed, kinds, inflections, mirrors)

QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
