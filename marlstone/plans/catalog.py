"""All queries of this package over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from marlstone.plans import graphs, media, retrieval, search, stores, texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (retrieval, search, stores, graphs, texts, media):
    QUERIES |= _module.HERE.queries
    ORACLES |= _module.HERE.oracles
