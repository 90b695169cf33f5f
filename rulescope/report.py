"""Health report job: one table + one rule file -> every dashboard output.

    python -m rulescope report --input sites.parquet --rules rules.json --out /shared/report
    spark-submit rulescope/report.py report --input ... (same arguments)

Evaluates the rules once into a copy in the shared folder
(:func:`views.materialized`), then derives the summary, KPI totals, the
deficiency matrix, the failure distributions and the per-KPI exports from
that copy: the rules run once however many outputs are written.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rulescope.operators import views as V
from rulescope.operators.exports import export_kpi, file_name
from rulescope.operators.rules import evaluate
from rulescope.session import shared_path
from rulescope.sources import files as FL
from rulescope.sources import folders
from rulescope.sources.headers import present_dimensions, with_circle
from rulescope.sources.rules_io import read_rules

# Dimensions of the distribution charts (cluster- and
# owner-wise views of the home page).
DISTRIBUTION_DIMS = ["Cluster", "Site- Principal Owner"]


def load_table(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Parquet, or CSV read with the cleaning rules; ``fmt="auto"`` takes a
    path ending in ``.csv`` as CSV."""
    csv = fmt == "csv" or (fmt == "auto" and path.lower().endswith(".csv"))
    if csv:  # parsed once; all later reads are of the Parquet copy
        return with_circle(FL.ingest_csv(spark, path, shared_path(spark, "ingested")))
    return with_circle(spark.read.parquet(path))


def run_report(
    spark: SparkSession,
    table: DataFrame,
    rules_path: str,
    out: str,
    *,
    matrix_keys: Sequence[str] | None = None,
    dims: Sequence[str] | None = None,
    top_n: int | None = None,
    severe_at: int = 3,
    on_missing: str = "error",
) -> dict[str, str]:
    """Write every output under ``out``; returns the paths by output name."""
    base = out.rstrip("/")
    lazy = evaluate(table, read_rules(spark, rules_path), on_missing=on_missing)
    keys = list(matrix_keys) if matrix_keys else V.hierarchy_keys(lazy.source_columns)
    present = present_dimensions(lazy.source_columns, list(dims) if dims else DISTRIBUTION_DIMS)
    # Only what the outputs need is copied; exports hold all input columns.
    needed = lazy.source_columns if lazy.dash_rules else list(dict.fromkeys([*keys, *present]))
    copy = shared_path(spark, "evaluated")
    ev = V.materialized(lazy, copy, keep=needed)
    written: dict[str, str] = {}

    def save(name: str, df: DataFrame) -> None:
        path = f"{base}/{name}"
        df.write.mode("overwrite").parquet(path)
        written[name] = path

    save("summary", V.health_summary(ev, severe_at=severe_at))
    save("kpi_totals", V.kpi_totals(ev))
    save("matrix", V.matrix(ev, keys))
    for dim in present:
        save(f"distribution_{file_name(dim, present)}", V.distribution_by_dim(ev, dim, top_n=top_n))
    for rule in ev.dash_rules:
        exports = export_kpi(ev, rule.name, f"{base}/exports", severe_at=severe_at, materialize=False)
        for name, path in exports.items():
            written[f"export_{file_name(rule.name, ev.names)}_{name}"] = path
    folders.discard(spark, copy)
    return written


def _top_n(text: str) -> int | None:
    return None if text.lower() == "all" else int(text)


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="rulescope")
    sub = ap.add_subparsers(dest="command", required=True)
    rep = sub.add_parser("report", help="evaluate a rule file over a table and write every view")
    rep.add_argument("--input", required=True, help="table path (Parquet or CSV)")
    rep.add_argument("--format", default="auto", choices=["auto", "parquet", "csv"])
    rep.add_argument("--rules", required=True, help="rule file (JSON array or JSON lines)")
    rep.add_argument("--out", required=True, help="output folder (shared file system)")
    rep.add_argument("--matrix-keys", nargs="*", default=None)
    rep.add_argument("--dims", nargs="*", default=None)
    rep.add_argument("--top-n", type=_top_n, default=None, help="entities per distribution: a number, or all (default)")
    rep.add_argument("--severe-at", type=int, default=3)
    rep.add_argument("--on-missing", default="error", choices=["error", "skip_rule", "ignore_layer"])
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("rulescope-report").getOrCreate()
    table = load_table(spark, args.input, args.format)
    written = run_report(
        spark,
        table,
        args.rules,
        args.out,
        matrix_keys=args.matrix_keys,
        dims=args.dims,
        top_n=args.top_n,
        severe_at=args.severe_at,
        on_missing=args.on_missing,
    )
    for name, path in sorted(written.items()):
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
