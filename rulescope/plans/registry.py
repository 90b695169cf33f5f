"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

from rulescope.plans import queries as _queries
from rulescope.plans import queries_packs as _packs  # noqa: F401  (registers)
from rulescope.plans import queries_trends as _trends  # noqa: F401  (registers)
from rulescope.plans import queries_stream as _stream  # noqa: F401  (registers)


def queries():
    return dict(_queries.QUERIES)


def oracle_sql():
    return dict(_queries.ORACLE)
