"""Ready-made rule packs, failure reasons and status-list inference.

All packs are plain :class:`Rule` lists evaluated by the one rule engine, so
they inherit its single-projection plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulescope.functions.columns import NO_TOKENS, YES_TOKENS, qcol
from rulescope.operators.rules import Evaluation, Rule

# The seven-rule default pack of the matrix dashboard, as
# shipped.  Its scope column is spelt "DG/ Non-DG" (with a space); column
# lookup ignores whitespace and case, so it still finds "DG/Non-DG".
DEFAULT_PACK = [
    {"name": "Automation Issue", "use_precond": True, "pre_col": "DG/ Non-DG", "pre_op": "==", "pre_val": "DG", "fail_col": "DG Automation (Yes/No)", "fail_op": "==", "fail_val": "No"},
    {"name": "SMPS/IPMS Fault", "use_precond": False, "pre_col": "", "pre_op": "==", "pre_val": "", "fail_col": "SMPS/IPMS/PIU Faulty (Yes/No)", "fail_op": "==", "fail_val": "Yes"},
    {"name": "Low BB", "use_precond": False, "pre_col": "", "pre_op": "==", "pre_val": "", "fail_col": "BB Low (Yes/No)", "fail_op": "==", "fail_val": "Yes"},
    {"name": "High Temp", "use_precond": False, "pre_col": "", "pre_op": "==", "pre_val": "", "fail_col": "High Temperature (Yes/No)", "fail_op": "==", "fail_val": "Yes"},
    {"name": "TCU Fault", "use_precond": False, "pre_col": "", "pre_op": "==", "pre_val": "", "fail_col": "TCU Status (OK/Not OK)", "fail_op": "==", "fail_val": "Not OK"},
    {"name": "Earthing Issue", "use_precond": False, "pre_col": "", "pre_op": "==", "pre_val": "", "fail_col": "Earthing Status (Ok/Not OK)", "fail_op": "==", "fail_val": "Not OK"},
    {"name": "Access Issue", "use_precond": False, "pre_col": "", "pre_op": "==", "pre_val": "", "fail_col": "Owner/Access Issues (Yes/No)", "fail_op": "==", "fail_val": "Yes"},
]

# Default failure-status lists (exact, case-insensitive) of the
# generator and RM checks, and the substring tokens of the later dashboard.
DG_FAIL_STATUSES = ["failed", "not reachable", "timeout", "no"]
RM_FAIL_STATUSES = ["failed", "no", "not ok", "0"]
DG_FAIL_SUBSTRINGS = ["fail", "no", "not"]
SNMP_FAIL_SUBSTRINGS = ["fail", "no"]
RM_FAIL_SUBSTRINGS = ["fail", "no", "degrade"]

# Failure-reason texts and the label of a row without failure.
REASON_DG = "DG Auto Failed"
REASON_SNMP = "SNMP Failed"
REASON_RM_V4 = "RM Failed"
REASON_RM_V5 = "RM (N+1) Failed"
REASON_BB_V4 = "Low Battery (<{t}h)"
REASON_BB_V5 = "Low BB (<{t}h)"
REASON_CUSTOM = "Custom Rule ({col})"
NO_REASON_V4 = "None"
NO_REASON_V5 = "100% OK"


def default_pack() -> list[Rule]:
    return [Rule.from_dict(d) for d in DEFAULT_PACK]


def fixed_kpi_pack(
    bb_col: str,
    dg_col: str,
    snmp_col: str,
    rm_col: str,
    *,
    bb_threshold: float = 4.0,
    use_bb: bool = True,
    use_dg: bool = True,
    use_snmp: bool = True,
    use_rm: bool = True,
) -> list[Rule]:
    """The four-KPI pack of the first dashboard, with its per-KPI missing
    value policy: battery below the threshold fails (missing passes); DG and
    SNMP fail unless the value is a yes-token (missing fails); RM fails only
    on an explicit no-token (missing passes)."""
    rules = []
    if use_bb:
        rules.append(Rule(name="bb", fail_col=bb_col, fail_op="<", fail_val=bb_threshold))
    if use_dg:
        rules.append(Rule(name="dg", fail_col=dg_col, fail_op="not in", fail_val=list(YES_TOKENS)))
    if use_snmp:
        rules.append(Rule(name="snmp", fail_col=snmp_col, fail_op="not in", fail_val=list(YES_TOKENS)))
    if use_rm:
        rules.append(Rule(name="rm", fail_col=rm_col, fail_op="in", fail_val=list(NO_TOKENS)))
    return rules


def status_rule(
    name: str,
    col: str,
    *,
    states: Sequence[str] | None = None,
    tokens: Sequence[str] | None = None,
    mode: str = "exact",
    reason: str | None = None,
    scope: tuple[str, str, str] | None = None,
) -> Rule:
    """A rule that fails when ``col`` holds a failure status.

    ``states`` is an explicit list of exact values.  Without it the failure
    statuses are inferred from ``tokens``: ``mode="exact"`` takes values whose
    lower-cased text is a token, ``"substring"`` values containing one.  The
    inferred list is exactly the set of values passing that test, so the rule
    applies the test itself; nothing is collected to the driver.
    """
    if states is not None:
        op, val = "in_exact", list(states)
    elif mode == "exact":
        op, val = "in_ci", list(tokens or [])
    elif mode == "substring":
        op, val = "contains_any", list(tokens or [])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    pre = {}
    if scope is not None:
        pre = {"use_pre": True, "pre_col": scope[0], "pre_op": scope[1], "pre_val": scope[2]}
    return Rule(name=name, fail_col=col, fail_op=op, fail_val=val, reason=reason, **pre)


def _status_test(col: str, tokens: Sequence[str], mode: str):
    low = F.lower(qcol(col).cast("string"))
    if mode == "exact":
        cond = low.isin([t.lower() for t in tokens])
    elif mode == "substring":
        cond = F.lit(False)
        for t in tokens:
            cond = cond | low.contains(t.lower())
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(cond, F.lit(False))


def status_inference(df: DataFrame, col: str, tokens: Sequence[str], mode: str = "exact") -> DataFrame:
    """Distinct values of ``col`` that count as failures by default
    (``value``), sorted.  The tokens are tested on the distinct values only
    (combined map-side)."""
    return (
        df.select(qcol(col)).distinct()
        .where(_status_test(col, tokens, mode))
        .select(qcol(col).cast("string").alias("value"))
        .distinct()
        .orderBy("value")
    )


def status_inference_many(
    df: DataFrame, col: str, specs: dict[str, tuple[Sequence[str], str]]
) -> DataFrame:
    """Several inferences at once (``label -> (tokens, mode)``) in one scan:
    ``label``, ``value`` rows, sorted."""
    if not specs:
        return df.sparkSession.createDataFrame([], "label string, value string")
    value = qcol(col).cast("string")
    rows = [
        F.struct(F.lit(label).alias("label"), value.alias("value"), _status_test(col, toks, mode).alias("keep"))
        for label, (toks, mode) in specs.items()
    ]
    return (
        df.select(qcol(col)).distinct()
        .select(F.inline(F.array(*rows)))
        .where("keep")
        .select("label", "value")
        .distinct()
        .orderBy("label", "value")
    )


def _fmt(t: float) -> str:
    return str(float(t))


def nested_kpi_pack(
    type_col: str,
    dg_col: str,
    bb_col: str,
    rm_col: str,
    *,
    snmp_col: str | None = None,
    bb_threshold: float = 4.0,
    dg_states: Sequence[str] | None = None,
    rm_states: Sequence[str] | None = None,
    snmp_states: Sequence[str] | None = None,
    custom: tuple[str, str] | None = None,
    dg_scope: str = "equals",
    generation: int = 5,
) -> list[Rule]:
    """The scoped ("nested") KPI packs with failure reasons.

    DG fails only on generator sites (scope on ``type_col``) whose status is
    a failure status; battery below the threshold fails (missing passes); RM
    and SNMP fail on failure statuses; an optional custom rule fails on an
    exact (trimmed, case-insensitive) value.  ``dg_scope="contains"``
    reproduces the original substring scope test, which also matches
    ``Non-DG``.  ``generation`` 4 or 5 selects rule order and reason texts.
    Status lists default to the inferred lists of that generation.
    """
    scope = (type_col, "Contains" if dg_scope == "contains" else "==", "DG")
    if generation == 4:
        dg = (
            status_rule("dg", dg_col, states=dg_states, reason=REASON_DG, scope=scope)
            if dg_states is not None
            else status_rule("dg", dg_col, tokens=DG_FAIL_STATUSES, mode="exact", reason=REASON_DG, scope=scope)
        )
        bb = Rule(name="bb", fail_col=bb_col, fail_op="<", fail_val=bb_threshold,
                  reason=REASON_BB_V4.format(t=_fmt(bb_threshold)))
        rm = (
            status_rule("rm", rm_col, states=rm_states, reason=REASON_RM_V4)
            if rm_states is not None
            else status_rule("rm", rm_col, tokens=RM_FAIL_STATUSES, mode="exact", reason=REASON_RM_V4)
        )
        rules = [dg, bb, rm]
        if custom is not None and custom[1]:
            rules.append(Rule(name="custom", fail_col=custom[0], fail_op="==", fail_val=custom[1],
                              reason=REASON_CUSTOM.format(col=custom[0])))
        return rules
    bb = Rule(name="bb", fail_col=bb_col, fail_op="<", fail_val=bb_threshold,
              reason=REASON_BB_V5.format(t=_fmt(bb_threshold)))
    dg = (
        status_rule("dg", dg_col, states=dg_states, reason=REASON_DG, scope=scope)
        if dg_states is not None
        else status_rule("dg", dg_col, tokens=DG_FAIL_SUBSTRINGS, mode="substring", reason=REASON_DG, scope=scope)
    )
    rules = [bb, dg]
    if snmp_col is not None:
        rules.append(
            status_rule("snmp", snmp_col, states=snmp_states, reason=REASON_SNMP)
            if snmp_states is not None
            else status_rule("snmp", snmp_col, tokens=SNMP_FAIL_SUBSTRINGS, mode="substring", reason=REASON_SNMP)
        )
    rules.append(
        status_rule("rm", rm_col, states=rm_states, reason=REASON_RM_V5)
        if rm_states is not None
        else status_rule("rm", rm_col, tokens=RM_FAIL_SUBSTRINGS, mode="substring", reason=REASON_RM_V5)
    )
    return rules


def with_reasons(
    ev: Evaluation,
    col: str = "Failure_Reasons",
    *,
    sep: str = "; ",
    empty_label: str = NO_REASON_V5,
) -> DataFrame:
    """Add the failure reasons of each row as text (rule order, ``sep``
    between reasons, ``empty_label`` when none).  ``array_join`` skips the
    NULLs of passing rules; no text is split back later."""
    parts = F.array(*[F.when(ev.fail(r.name), F.lit(r.label)) for r in ev.rules])
    text = F.nullif(F.array_join(parts, sep), F.lit(""))
    return ev.df.withColumn(col, F.coalesce(text, F.lit(empty_label)))


def reason_distribution(ev: Evaluation) -> DataFrame:
    """Number of deficient sites per failure reason (a site with several
    reasons counts once per reason).  Counts are taken per rule in one
    aggregate, then unpivoted; rules sharing a reason text add up."""
    labels: dict[str, list[str]] = {}
    for r in ev.rules:
        labels.setdefault(r.label, []).append(r.name)
    aggs = []
    for i, names in enumerate(labels.values()):
        total = None
        for n in names:
            c = F.count_if(ev.fail(n))
            total = c if total is None else total + c
        aggs.append(total.alias(f"__r{i}"))
    if not aggs:
        return ev.df.sparkSession.createDataFrame([], "reason string, sites bigint")
    structs = [
        F.struct(F.lit(label).alias("reason"), F.col(f"__r{i}").alias("sites"))
        for i, label in enumerate(labels)
    ]
    return ev.df.agg(*aggs).select(F.inline(F.array(*structs))).where(F.col("sites") > 0)
