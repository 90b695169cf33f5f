"""Rule sets as JSON files.

A rule set is configuration: a short, user-written list (tens to hundreds of
rules), so it is read to the driver and compiled there into one projection.
Files hold a JSON array of rule objects (the format users exchange) or JSON
lines; both are read and written through Spark, so the path may be on any
shared file system.  Values keep their JSON type: a list stays a list,
whatever commas and padding its items hold.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterable
from dataclasses import fields

from pyspark.sql import SparkSession

from rulescope.operators.rules import Rule

_FIELDS = {f.name for f in fields(Rule)}
_LIST_OPS = ("in", "not in", "in_exact", "in_ci", "contains_any")
_VALUE_OF = {"pre_op": "pre_val", "fail_op": "fail_val", "nest_op": "nest_val", "sev_op": "sev_val"}
_REGEX_MARKS = re.compile(r"[|^$*+?()\[\]{}\\]|\.\*")


def rule_of(record: dict) -> Rule:
    """A rule from one record; older names are understood, unknown keys and
    NULLs are left out.  The text of a JSON list is read as that list where
    the operator takes one."""
    d = {k: v for k, v in record.items() if v is not None}
    if "use_pre" not in d and "use_precond" in d:
        d["use_pre"] = d["use_precond"]
    for op, val in _VALUE_OF.items():
        v = d.get(val)
        if d.get(op) in _LIST_OPS and isinstance(v, str) and v.lstrip().startswith("["):
            try:
                d[val] = json.loads(v)
            except json.JSONDecodeError:
                pass  # hand-written text that only looks like a list
        if d.get(op) == "Contains" and "regex" not in record and isinstance(v, str) and _REGEX_MARKS.search(v):
            warnings.warn(
                f"rule {d.get('name')!r}: {val} {v!r} looks like a regular expression but is matched as plain text; "
                "add \"regex\": true to search by pattern",
                stacklevel=2,
            )
    return Rule.from_dict({k: v for k, v in d.items() if k in _FIELDS})


def write_rules(spark: SparkSession, rules: Iterable[Rule], path: str) -> None:
    """Write a rule set as one JSON array on one line: the folder ``path``
    holds a single small part file (Spark's output layout)."""
    text = spark.createDataFrame([(rules_to_json(rules),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Read a rule set written by :func:`write_rules` or exchanged as a JSON
    array / JSON lines; 8-key files (``use_precond``) load too.  Records with
    a ``rule_no`` are ordered by it."""
    records: list[dict] = []
    files = spark.read.text(path, wholetext=True).orderBy("value").collect()
    for row in files:
        text = row["value"].strip()
        if not text:
            continue
        if text.startswith("["):
            records += json.loads(text)
        else:
            records += _objects(text)
    order = sorted(range(len(records)), key=lambda i: (records[i].get("rule_no") is None, records[i].get("rule_no") or 0, i))
    return [rule_of(records[i]) for i in order]


def _objects(text: str) -> list[dict]:
    """JSON objects one after the other, on one line each or pretty-printed."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while at < len(text):
        value, at = decoder.raw_decode(text, at)
        out.append(value)
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
    return out


def rules_to_json(rules: Iterable[Rule]) -> str:
    """Driver-side JSON text of a rule set (for download buttons and tests)."""
    return json.dumps([r.to_dict() for r in rules])


def rules_from_json(text: str) -> list[Rule]:
    return [rule_of(d) for d in json.loads(text)]
