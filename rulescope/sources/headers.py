"""Column-name work for wide, hand-made tables.

Only ``df.columns`` is read on the driver; the data work stays distributed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from rulescope.functions.columns import CIRCLE_DEFAULT, CIRCLE_PREFIXES, prefix_label, qcol


def normalize_header(name: object) -> str:
    """White space of any kind, line breaks included, to single spaces."""
    return " ".join(str(name).split())


def make_unique(names: Sequence[str]) -> list[str]:
    """De-duplicate names with ``__n`` suffixes (the first keeps its name).

    Spark resolves names case-insensitively, so names equal ignoring case
    count as duplicates too.  A generated name never collides with a name
    already in the input (a literal ``X__1`` keeps its name), so the result
    is always unique.
    """
    reserved = {n.lower() for n in names}
    taken: set[str] = set()
    counts: dict[str, int] = {}
    out = []
    for n in names:
        key = n.lower()
        if key not in taken:
            taken.add(key)
            out.append(n)
            continue
        k = counts.get(key, 0)
        while True:
            k += 1
            cand = f"{n}__{k}"
            if cand.lower() not in taken and cand.lower() not in reserved:
                break
        counts[key] = k
        taken.add(cand.lower())
        out.append(cand)
    return out


def clean_headers(df: DataFrame) -> DataFrame:
    """Normalise and de-duplicate all column names (a metadata-only rename)."""
    return df.toDF(*make_unique([normalize_header(c) for c in df.columns]))


def matching_columns(
    columns: Sequence[str], *, pattern: str | None = None, keywords: Sequence[str] | None = None
) -> list[str]:
    """All columns, in table order, whose lower-cased name matches the regular
    expression ``pattern`` or holds one of the ``keywords``."""
    tests = [re.escape(k.lower()) for k in keywords or ()]
    if pattern is not None:
        tests.append(pattern)
    if not tests:
        return []
    found = re.compile("|".join(f"(?:{t})" for t in tests))
    return [c for c in columns if found.search(c.lower())]


def find_columns(columns: Sequence[str], pattern: str) -> list[str]:
    return matching_columns(columns, pattern=pattern)


def find_column(columns: Sequence[str], pattern: str) -> str | None:
    """First match of a pattern; None when nothing matches."""
    return next(iter(matching_columns(columns, pattern=pattern)), None)


def find_by_keywords(columns: Sequence[str], keywords: Sequence[str]) -> str | None:
    """First column that holds any keyword; None when none does."""
    return next(iter(matching_columns(columns, keywords=keywords)), None)


def resolve_roles(
    columns: Sequence[str],
    patterns: Mapping[str, str | Sequence[str]],
    overrides: Mapping[str, str] | None = None,
) -> tuple[dict[str, str | None], dict[str, list[str]]]:
    """Role -> column map.  An explicit override wins; otherwise the first
    match of the role's pattern (or of its keywords, if it has a list of
    them).  Also returns the roles that matched more than one column
    (ambiguous, worth a look)."""
    overrides = dict(overrides or {})
    out: dict[str, str | None] = {}
    ambiguous: dict[str, list[str]] = {}
    for role, pat in patterns.items():
        if role in overrides:
            if overrides[role] not in columns:
                raise ValueError(f"override for {role!r}: no column {overrides[role]!r}")
            out[role] = overrides[role]
            continue
        hits = matching_columns(columns, pattern=pat) if isinstance(pat, str) else matching_columns(columns, keywords=pat)
        out[role] = hits[0] if hits else None
        if len(hits) > 1:
            ambiguous[role] = hits
    return out, ambiguous


def select_roles(df: DataFrame, roles: Mapping[str, str | None]) -> DataFrame:
    """Project the mapped columns under their role names."""
    return df.select(*[qcol(src).alias(role) for role, src in roles.items() if src is not None])


def present_dimensions(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The optional dimensions that exist (exact names), in ``wanted`` order."""
    cols = set(columns)
    return [w for w in wanted if w in cols]


# How a site-id column is named (lower-cased).
SITE_ID_NAMES = ("site id", "site_id")


def site_column(columns: Sequence[str]) -> str | None:
    """The site-id column."""
    return find_by_keywords(columns, SITE_ID_NAMES)


def with_circle(df: DataFrame, out_col: str = "Auto_Circle") -> DataFrame:
    """Add the region label derived from the site-id prefix, when there is a
    site-id column and ``out_col`` is not already present."""
    site = site_column(df.columns)
    if site is None or out_col in df.columns:
        return df
    return df.withColumn(out_col, prefix_label(site, CIRCLE_PREFIXES, CIRCLE_DEFAULT))


# Role patterns of the fixed-KPI dashboards (lower-cased names).
ROLE_PATTERNS_V1 = {
    "Site ID": r"site.*id",
    "Cluster": r"cluster",
    "Battery Backup (Hrs)": r"battery.*backup.*hrs",
    "DG Automation": r"dg.*automation",
    "SNMP Communicated": r"snmp.*communicated",
    "RM Count": r"rm.*count",
}
ROLE_PATTERNS_V5 = {
    "Site ID": r"site.*id",
    "Cluster": r"cluster",
    "Site Type (DG/Non-DG)": r"dg.*non|site.*type|macro",
    "Battery Backup (Hrs)": r"battery.*backup|bb.*hrs",
    "DG Automation": r"dg.*automation|dg.*status",
    "SNMP Communicated": r"snmp",
    "RM Count": r"rm.*count|rm.*n\+1",
}

# Role keywords of the second dashboard (lower-case substrings).
ROLE_KEYWORDS_V4 = {
    "Site ID": ["site id", "site_id", "siteid"],
    "Cluster": ["cluster", "zone"],
    "DG Type (Macro/ULS)": ["dg/non", "site type", "macro"],
    "DG Automation Status": ["automation status", "snmp", "dg auto"],
    "Battery Backup (Hrs)": ["battery backup (hrs)", "battery", "backup"],
    "RM Count": ["rm count", "rm (n+1)", "rm status"],
}
