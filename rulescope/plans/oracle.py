"""DuckDB SQL fragments used to write the oracle queries.

These mirror the semantics of :mod:`rulescope.functions.columns` in DuckDB's
dialect, so the oracle for a query states the same computation in plain SQL.
"""

from __future__ import annotations


def d_norm(x: str) -> str:
    """lower + strip whitespace at both ends (NULL stays NULL)."""
    return f"lower(regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g'))"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def d_num_text(x: str) -> str:
    """pandas-style numeric coercion of a text expression."""
    s = d_strip(x)
    return (
        f"(CASE WHEN regexp_full_match({s}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
        f"THEN (CASE WHEN isinf(TRY_CAST({s} AS DOUBLE)) THEN NULL ELSE TRY_CAST({s} AS DOUBLE) END) "
        f"WHEN regexp_full_match(lower({x}), '[+-]?inf(inity)?') THEN TRY_CAST({x} AS DOUBLE) END)"
    )


def d_pct(n: str, total: str) -> str:
    return f"(CASE WHEN {total} > 0 THEN CAST({n} AS DOUBLE) / CAST({total} AS DOUBLE) * 100.0 ELSE 0.0 END)"


def d_pct_text(n: str, total: str) -> str:
    return f"concat(CAST(round_even({d_pct(n, total)}, 1) AS VARCHAR), '%')"


def d_eq(x: str, v: str) -> str:
    return f"coalesce({d_norm(x)} = '{v.strip().lower()}', false)"


def d_ne(x: str, v: str) -> str:
    return f"(NOT ({d_norm(x)} IS NOT DISTINCT FROM '{v.strip().lower()}'))"


def d_contains(x: str, v: str) -> str:
    return f"coalesce(contains({d_norm(x)}, '{v.strip().lower()}'), false)"


def d_cmp(x: str, op: str, t: float) -> str:
    return f"coalesce({x} {op} {t!r}, false)"


def d_int_sum(flags: list[str]) -> str:
    return "(" + " + ".join(f"CAST({f} AS INTEGER)" for f in flags) + ")"


def d_pct_card_text(n: str, total: str) -> str:
    """Card label: Python-style ``.1f`` of the double (DuckDB's printf
    formats the binary value exactly)."""
    return f"concat(printf('%.1f', {d_pct(n, total)}), '%')"
