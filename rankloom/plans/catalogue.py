"""The registered queries of the ranking engine and their SQL."""

from __future__ import annotations

from . import etl, evaluation, files, profiles, ranking, search, tuning

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (search, ranking, evaluation, etl, profiles, files, tuning):
    QUERIES |= _module.BOOK.queries
    ORACLES |= _module.BOOK.oracles
