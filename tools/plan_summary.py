"""Summarise the physical plan of every query of the library itself as a markdown table.

usage: python tools/plan_summary.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")

from rulescope.plans import registry  # noqa: E402
from rulescope.session import local_session  # noqa: E402


def _combined_before_shuffle(plan: str) -> str:
    """How many hash shuffles have a HashAggregate directly beneath them
    (map-side combine), as ``k/n``; ``-`` without hash shuffles."""
    lines = plan.splitlines()
    n = k = 0
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            n += 1
            child = next((ln for ln in lines[i + 1:] if "+-" in ln), "")
            k += "HashAggregate" in child
    return f"{k}/{n}" if n else "-"


def summary(plan: str) -> dict[str, int]:
    return {
        "scans": len(re.findall(r"FileScan |Scan parquet|StreamingRelation|InMemoryTableScan", plan)),
        "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range_exchanges": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single_exchanges": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "top_k": len(re.findall(r"TakeOrderedAndProject", plan)),
        "combined": _combined_before_shuffle(plan),
        "python": any(n in plan for n in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    print("| query | scans | hash shuffles | combined map-side | range shuffles | to one partition | broadcasts | top-k | Python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in sorted(registry.queries().items()):
        df = fn(spark, sf)
        s = summary(df._jdf.queryExecution().executedPlan().toString())
        print(
            f"| `{name}` | {s['scans']} | {s['hash_exchanges']} | {s['combined']} | {s['range_exchanges']} "
            f"| {s['single_exchanges']} | {s['broadcasts']} | {s['top_k']} | {'yes' if s['python'] else 'no'} |"
        )
    spark.stop()


if __name__ == "__main__":
    main()
