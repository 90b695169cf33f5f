"""Actionable CSV exports of a KPI deep dive.

Several exports come from one evaluation: the evaluated table is written
once to the shared folder (:func:`views.materialized`) and every export is a
filter on that copy, pushed into its Parquet scan, so the rules run once
however many files are produced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import functions as F

from rulescope.operators import views as V
from rulescope.operators.rules import Evaluation
from rulescope.sources.files import write_csv


def file_name(text: str, among: Iterable[str] = ()) -> str:
    """A name for files: letters, digits, ``-`` and ``_`` stay, the rest
    becomes ``_``.  If that gives another text of ``among`` the same name
    (``A/B`` and ``A B``), a checksum of the text keeps them apart."""

    def safe(t: str) -> str:
        return "".join(ch if ch.isalnum() or ch in "-_" else "_" for ch in t)

    shared = any(t != text and safe(t).lower() == safe(text).lower() for t in among)
    return f"{safe(text)}-{zlib.crc32(text.encode()):08x}" if shared else safe(text)


def export_kpi(
    ev: Evaluation,
    rule: str,
    folder: str,
    *,
    severe_at: int = 3,
    single_file: bool = False,
    materialize: bool = True,
) -> dict[str, str]:
    """Write ``<rule>_actionable`` (all sites failing ``rule``) and
    ``<rule>_SEVERE`` (those with at least ``severe_at`` failures in total)
    as CSV folders under ``folder``, without the generated columns.

    Returns the written paths by export name; an export with no rows is
    still written (header only), so readers need no special case.  Pass
    ``materialize=False`` when ``ev`` already reads a written copy.
    """
    failing = ev.where(ev.fail(rule))
    copy = V.materialized(failing) if materialize else failing
    base = folder.rstrip("/")
    safe = file_name(rule, ev.names)
    paths = {
        "actionable": f"{base}/{safe}_actionable",
        "severe": f"{base}/{safe}_SEVERE",
    }
    write_csv(copy.clean(), paths["actionable"], single_file=single_file)
    write_csv(copy.where(F.col(copy.total_col) >= severe_at).clean(), paths["severe"], single_file=single_file)
    return paths
