"""Rule records and the rule compiler.

A rule says: *within a scope* (optional pre-condition), a row **fails** when
its failure condition holds *and* an optional nested condition holds; a
failing row is **critical** when an optional severity condition also holds.

Every condition compiles to Spark SQL text (names and values escaped, so a
rule file cannot inject SQL); ``evaluate`` puts all flags of a rule set into
one ``selectExpr`` over the input, adds the severity flags, the per-row
failure count and the all-OK flag in a second one, and returns the (lazy)
DataFrame together with the names it generated.  No UDF, no action:
Catalyst prunes the flags a view does not use and pushes filters on input
columns into the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulescope.functions.columns import (
    NUMBER_TEXT,
    balanced_sql_sum,
    in_tokens_sql,
    is_numeric_type,
    norm_sql,
    norm_value,
    num_sql,
    qcol,
    sql_double,
    sql_ident,
    sql_list,
    sql_str,
)

TEXT_OPS = ("==", "!=", "Contains")
NUMERIC_OPS = (">", "<", ">=", "<=")
SET_OPS = ("in", "not in", "in_exact", "in_ci", "contains_any")
ALL_OPS = TEXT_OPS + NUMERIC_OPS + SET_OPS

FAIL_PREFIX = "FAIL_"
CRIT_PREFIX = "CRIT_"
TOTAL_COL = "_TOTAL_FAILS"
OK_COL = "_IS_OK"

_NUMBER_RE = re.compile(NUMBER_TEXT.strip("^$"))
# Digits with at most one dot, at least one digit.
_UNSIGNED_DECIMAL = re.compile(r"[0-9]+\.?[0-9]*|\.[0-9]+")


class RuleError(ValueError):
    """A rule set that cannot be compiled against the given table."""


@dataclass(frozen=True)
class Rule:
    """One KPI rule.  Field names follow the JSON rule files users exchange."""

    name: str
    fail_col: str
    fail_op: str = "=="
    fail_val: Any = None
    use_pre: bool = False
    pre_col: str | None = None
    pre_op: str | None = "=="
    pre_val: Any = None
    use_nested: bool = False
    nest_col: str | None = None
    nest_op: str | None = "=="
    nest_val: Any = None
    use_severe: bool = False
    sev_col: str | None = None
    sev_op: str | None = "=="
    sev_val: Any = None
    make_dash: bool = False
    # Extensions (not in older rule files; defaults keep old files valid).
    regex: bool = False  # `Contains` as a regular expression (Java dialect)
    reason: str | None = None  # failure-reason text; defaults to the name

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> Rule:
        """Accept both rule-file generations: 17-key records with ``use_pre``
        and 8-key records that spell the switch ``use_precond``."""
        known = {f.name for f in fields(cls)}
        data = {k: v for k, v in d.items() if k in known}
        if "use_pre" not in d and "use_precond" in d:
            data["use_pre"] = d["use_precond"]
        if "name" not in data or "fail_col" not in data:
            raise RuleError(f"rule needs 'name' and 'fail_col': {dict(d)!r}")
        for flag in ("use_pre", "use_nested", "use_severe", "make_dash", "regex"):
            data[flag] = bool(data.get(flag) or False)
        return cls(**data)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @property
    def fail_flag(self) -> str:
        return FAIL_PREFIX + self.name

    @property
    def crit_flag(self) -> str:
        return CRIT_PREFIX + self.name

    @property
    def label(self) -> str:
        return self.reason if self.reason is not None else self.name


def parse_threshold(val: Any, mode: str = "strict") -> float:
    """Threshold of a numeric comparison.

    ``strict`` (default) accepts signed, decimal and exponent forms and
    rejects anything else.  ``compat`` reproduces the original dashboards:
    only digits with at most one dot parse, everything else is 0.
    """
    text = "" if val is None else str(val)
    if mode == "compat":
        return float(text) if _UNSIGNED_DECIMAL.fullmatch(text) else 0.0
    stripped = text.strip()
    if not _NUMBER_RE.fullmatch(stripped):
        raise RuleError(f"threshold {val!r} is not a number")
    out = float(stripped)
    if out != out or out in (float("inf"), float("-inf")):
        raise RuleError(f"threshold {val!r} is not finite")
    return out


def _as_number(val: Any) -> float | None:
    if isinstance(val, bool):
        return None
    if isinstance(val, (int, float)):
        return float(val)
    text = "" if val is None else str(val).strip()
    return float(text) if _NUMBER_RE.fullmatch(text) else None


def _token_list(val: Any) -> list[str]:
    if val is None:
        return []
    if isinstance(val, str):
        return [t for t in (p.strip() for p in val.split(",")) if t]
    return [str(v) for v in val]


def condition_sql(
    col_name: str,
    op: str,
    val: Any,
    dtype: T.DataType | None = None,
    *,
    regex: bool = False,
    threshold_mode: str = "strict",
    strict_ops: bool = True,
) -> str:
    """Spark SQL text of one ``column OP value`` test (never NULL).

    * ``==``: case- and whitespace-insensitive text equality; numeric
      columns compare numerically when the value is a number.  NULL -> false.
    * ``!=``: negation of ``==`` where a missing value counts as *not equal*.
    * ``Contains``: literal substring of the normalised text (``regex=True``:
      case-insensitive regular expression search).  NULL -> false.
    * ``> < >= <=``: numeric comparison after :func:`num` coercion; text that
      is not a number, NULL and NaN -> false.
    * ``in`` / ``not in``: normalised membership in a token list (``not in``
      is true for NULL); ``in_exact``: exact text membership; ``in_ci``:
      case-insensitive exact membership (no trimming); ``contains_any``:
      case-insensitive substring of any token.  NULL -> false for these.
    """
    c = sql_ident(col_name)
    numeric_col = dtype is not None and is_numeric_type(dtype)
    if op in ("==", "!="):
        number = _as_number(val) if numeric_col else None
        if number is not None:
            left, right = num_sql(c, dtype), sql_double(number)
        else:
            left, right = norm_sql(c), sql_str(norm_value(val))
        if op == "==":
            return f"coalesce({left} = {right}, false)"
        return f"(NOT ({left} <=> {right}))"
    if op == "Contains":
        if regex:
            # case-insensitive match; the pattern is only stripped, not
            # lower-cased, so escapes such as \D keep their meaning
            return f"coalesce({norm_sql(c)} RLIKE {sql_str('(?iu)' + str(val).strip())}, false)"
        return f"coalesce(contains({norm_sql(c)}, {sql_str(norm_value(val))}), false)"
    if op in NUMERIC_OPS:
        t = sql_double(parse_threshold(val, threshold_mode))
        return f"coalesce({num_sql(c, dtype)} {op} {t}, false)"
    if op in ("in", "not in"):
        member = f"coalesce({in_tokens_sql(c, _token_list(val))}, false)"
        return member if op == "in" else f"(NOT {member})"
    if op == "in_exact":
        tokens = _token_list(val)
        return f"coalesce(CAST({c} AS STRING) IN ({sql_list(tokens)}), false)" if tokens else "false"
    if op == "in_ci":
        tokens = sorted({str(t).lower() for t in _token_list(val)})
        return f"coalesce(lower(CAST({c} AS STRING)) IN ({sql_list(tokens)}), false)" if tokens else "false"
    if op == "contains_any":
        tests = [f"contains(lower(CAST({c} AS STRING)), {sql_str(str(t).lower())})" for t in _token_list(val)]
        return f"coalesce({' OR '.join(tests)}, false)" if tests else "false"
    if strict_ops:
        raise RuleError(f"unknown operator {op!r}")
    return "false"


def compile_condition(
    col_name: str,
    op: str,
    val: Any,
    dtype: T.DataType | None = None,
    **kw: Any,
) -> Column:
    """:func:`condition_sql` as a boolean Column."""
    return F.expr(condition_sql(col_name, op, val, dtype, **kw))


def resolve_column(columns: Sequence[str], name: str | None) -> str | None:
    """Find ``name`` among ``columns``: exact first, then ignoring case and
    all whitespace (so ``'DG/ Non-DG'`` finds ``'DG/Non-DG'``).  An ambiguous
    loose match resolves to nothing."""
    if name is None or name == "":
        return None
    if name in columns:
        return name
    key = re.sub(r"\s+", "", name).lower()
    hits = [c for c in columns if re.sub(r"\s+", "", c).lower() == key]
    return hits[0] if len(hits) == 1 else None


@dataclass
class Evaluation:
    """An evaluated table: the lazy DataFrame plus the names of what was added."""

    df: DataFrame
    rules: list[Rule]
    source_columns: list[str]
    skipped: list[tuple[str, str]] = field(default_factory=list)
    total_col: str = TOTAL_COL
    ok_col: str = OK_COL

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    @property
    def fail_cols(self) -> list[str]:
        return [r.fail_flag for r in self.rules]

    @property
    def crit_cols(self) -> list[str]:
        return [r.crit_flag for r in self.rules]

    @property
    def generated(self) -> list[str]:
        return self.fail_cols + self.crit_cols + [self.total_col, self.ok_col]

    @property
    def dash_rules(self) -> list[Rule]:
        """Applied rules flagged for a dedicated deep-dive page."""
        return [r for r in self.rules if r.make_dash]

    def rule(self, name: str) -> Rule:
        for r in self.rules:
            if r.name == name:
                return r
        raise RuleError(f"rule {name!r} was not applied (skipped: {self.skipped})")

    def fail(self, name: str) -> Column:
        return qcol(self.rule(name).fail_flag)

    def crit(self, name: str) -> Column:
        return qcol(self.rule(name).crit_flag)

    @property
    def total(self) -> Column:
        return qcol(self.total_col)

    @property
    def ok(self) -> Column:
        return qcol(self.ok_col)

    def failing(self) -> Column:
        """The names of the failing rules, in rule order, as an array."""
        if not self.rules:
            return F.expr("cast(array() as array<string>)")
        return F.array_compact(F.array(*[F.when(self.fail(r.name), F.lit(r.name)) for r in self.rules]))

    def with_df(self, df: DataFrame) -> Evaluation:
        """Same names over a derived DataFrame (e.g. after a drill-down)."""
        return replace(self, df=df)

    def where(self, cond: Column) -> Evaluation:
        return self.with_df(self.df.where(cond))

    def clean(self) -> DataFrame:
        """Input columns only (generated flags removed), in input order."""
        present = set(self.df.columns)
        return self.df.select([qcol(c) for c in self.source_columns if c in present])


def _rules_from(rules: Iterable[Rule | Mapping[str, Any]]) -> list[Rule]:
    out = [r if isinstance(r, Rule) else Rule.from_dict(r) for r in rules]
    seen: set[str] = set()
    for r in out:
        if not r.name:
            raise RuleError("rule without a name")
        # Spark resolves column names case-insensitively: "A" and "a" clash
        if r.name.lower() in seen:
            raise RuleError(f"duplicate rule name {r.name!r} (names are compared ignoring case)")
        seen.add(r.name.lower())
    return out


def rule_sql(
    rule: Rule,
    schema: T.StructType,
    *,
    on_missing: str = "error",
    threshold_mode: str = "strict",
    strict_ops: bool = True,
) -> tuple[str, str | None] | None:
    """SQL text of one rule against ``schema``: ``(fail, severity or None)``.

    Returns ``None`` when the rule's failure column is absent (the rule is
    skipped).  An absent scope / nested / severity column raises by default;
    ``on_missing="ignore_layer"`` drops that layer (the dashboards' lenient
    behaviour) and ``"skip_rule"`` skips the whole rule.
    """
    if on_missing not in ("error", "skip_rule", "ignore_layer"):
        raise RuleError(f"unknown on_missing policy {on_missing!r}")
    names = [f.name for f in schema.fields]
    types = {f.name: f.dataType for f in schema.fields}

    def cond(col: str | None, op: str | None, val: Any, layer: str) -> str | None:
        actual = resolve_column(names, col)
        if actual is None:
            if on_missing == "ignore_layer":
                return None
            if on_missing == "skip_rule":
                raise _Skip(f"{layer} column {col!r} not found")
            raise RuleError(f"rule {rule.name!r}: {layer} column {col!r} not found")
        return condition_sql(
            actual,
            op or "==",
            val,
            types[actual],
            regex=rule.regex,
            threshold_mode=threshold_mode,
            strict_ops=strict_ops,
        )

    fail_actual = resolve_column(names, rule.fail_col)
    if fail_actual is None:
        return None
    try:
        parts = []
        if rule.use_pre:
            parts.append(cond(rule.pre_col, rule.pre_op, rule.pre_val, "scope"))
        parts.append(
            condition_sql(
                fail_actual,
                rule.fail_op,
                rule.fail_val,
                types[fail_actual],
                regex=rule.regex,
                threshold_mode=threshold_mode,
                strict_ops=strict_ops,
            )
        )
        if rule.use_nested:
            parts.append(cond(rule.nest_col, rule.nest_op, rule.nest_val, "nested"))
        sev = cond(rule.sev_col, rule.sev_op, rule.sev_val, "severity") if rule.use_severe else None
    except _Skip:
        return None
    fail = " AND ".join(f"({p})" for p in parts if p is not None)
    return fail, sev


def validate_rules(
    rules: Iterable[Rule | Mapping[str, Any]],
    schema: T.StructType,
    *,
    threshold_mode: str = "strict",
) -> list[str]:
    """Every problem of a rule set against ``schema``, as messages (empty
    when the set compiles): unreadable records, duplicate names, unknown
    operators, non-numeric thresholds and missing columns.  Driver-only; no
    data is read."""
    problems: list[str] = []
    seen: set[str] = set()
    for i, raw in enumerate(rules):
        try:
            r = raw if isinstance(raw, Rule) else Rule.from_dict(raw)
        except (RuleError, TypeError) as e:
            problems.append(f"rule #{i + 1}: {e}")
            continue
        if r.name.lower() in seen:
            problems.append(f"rule {r.name!r}: duplicate name (ignoring case)")
        seen.add(r.name.lower())
        if resolve_column([f.name for f in schema.fields], r.fail_col) is None:
            problems.append(f"rule {r.name!r}: failure column {r.fail_col!r} not found")
            continue
        try:
            rule_sql(r, schema, on_missing="error", threshold_mode=threshold_mode)
        except RuleError as e:
            problems.append(f"rule {r.name!r}: {e}" if not str(e).startswith("rule ") else str(e))
    return problems


def compile_rule(rule: Rule, schema: T.StructType, **kw: Any) -> tuple[Column, Column] | None:
    """One rule as ``(fail, crit)`` Columns (see :func:`rule_sql`)."""
    compiled = rule_sql(rule, schema, **kw)
    if compiled is None:
        return None
    fail, sev = compiled
    crit = f"({fail}) AND ({sev})" if sev is not None else "false"
    return F.expr(fail), F.expr(crit)


#: Flags of a word: a BIGINT without its sign.
WORD_BITS = 63
FAIL_WORD, CRIT_WORD = "FAIL_BITS_", "CRIT_BITS_"
#: Zero, by a function that Spark leaves out of whole-stage code.  There, all
#: conditions would be one method, which the JVM does not compile if it is
#: large; a projection of its own is split into small ones (100 rules over
#: 150,000 rows: 1.0 s, within whole-stage code 6.4 s).
_APART = "element_at(transform(array(0L), x -> x), 1)"


@dataclass
class PackedEvaluation(Evaluation):
    """An evaluation whose flags are bits: rule k is bit ``k % WORD_BITS`` of
    the columns ``FAIL_BITS_<k // WORD_BITS>`` and ``CRIT_BITS_...``.  Every
    view takes it like an :class:`Evaluation`."""

    def __post_init__(self) -> None:
        self._at = {r.name: k for k, r in enumerate(self.rules)}

    def _bit(self, prefix: str, name: str) -> Column:
        k = self._at.get(name)
        if k is None:
            raise RuleError(f"rule {name!r} was not applied (skipped: {self.skipped})")
        return F.getbit(qcol(f"{prefix}{k // WORD_BITS}"), F.lit(k % WORD_BITS)) == 1

    def fail(self, name: str) -> Column:
        return self._bit(FAIL_WORD, name)

    def crit(self, name: str) -> Column:
        return self._bit(CRIT_WORD, name)

    @property
    def _words(self) -> range:
        return range(-(-len(self.rules) // WORD_BITS))

    @property
    def fail_cols(self) -> list[str]:
        return [f"{FAIL_WORD}{w}" for w in self._words]

    @property
    def crit_cols(self) -> list[str]:
        return [f"{CRIT_WORD}{w}" for w in self._words]

    def failing(self) -> Column:
        """As of any evaluation, by one test of a bit for each name instead of
        one expression for each rule."""
        if not self.rules:
            return super().failing()
        names = F.array(*[F.lit(r.name) for r in self.rules])
        words = F.array(*[qcol(c) for c in self.fail_cols])

        def fails(_: Column, k: Column) -> Column:
            return F.getbit(F.get(words, (k / WORD_BITS).cast("int")), k % WORD_BITS) == 1

        return F.filter(names, fails)

    def unpacked(self) -> Evaluation:
        """With one ``FAIL_`` and ``CRIT_`` column per rule."""
        made = set(self.generated)
        kept = [qcol(c) for c in self.df.columns if c not in made]
        tail = [qcol(self.total_col), qcol(self.ok_col)]
        flags = [self.fail(r.name).alias(r.fail_flag) for r in self.rules]
        flags += [self.crit(r.name).alias(r.crit_flag) for r in self.rules]
        values = {f: getattr(self, f) for f in ("rules", "source_columns", "skipped", "total_col", "ok_col")}
        return Evaluation(df=self.df.select(*kept, *flags, *tail), **values)


class _Skip(Exception):
    pass


def _applied(
    df: DataFrame, rules: Iterable[Rule | Mapping[str, Any]], **kw: Any
) -> tuple[list[tuple[Rule, str, str | None]], list[tuple[str, str]]]:
    """Rules that apply to ``df`` with the SQL of their failure and severity
    conditions, and the skipped ones with the reason."""
    applied, skipped = [], []
    schema = df.schema
    for r in _rules_from(rules):
        compiled = rule_sql(r, schema, **kw)
        if compiled is None:
            skipped.append((r.name, f"column {r.fail_col!r} (or a required layer) not found"))
        else:
            applied.append((r, *compiled))
    return applied, skipped


def _free_names(df: DataFrame, names: Iterable[str]) -> None:
    clash = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() in clash:
            raise RuleError(f"output column {name!r} already exists in the input")


def evaluate_packed(
    df: DataFrame,
    rules: Iterable[Rule | Mapping[str, Any]],
    *,
    on_missing: str = "error",
    threshold_mode: str = "strict",
    strict_ops: bool = True,
    total_col: str = TOTAL_COL,
    ok_col: str = OK_COL,
) -> PackedEvaluation:
    """As :func:`evaluate`, with the flags of up to ``WORD_BITS`` rules in one
    BIGINT column: for rule sets of hundreds of rules, whose wide tables take
    long to plan and to write.  The failure count is the number of bits set.
    """
    applied, skipped = _applied(df, rules, on_missing=on_missing, threshold_mode=threshold_mode, strict_ops=strict_ops)
    out = PackedEvaluation(df, [r for r, _, _ in applied], list(df.columns), skipped, total_col, ok_col)
    _free_names(df, out.generated)

    def word(conditions: list[str | None]) -> str:
        bits = [f"IF({c}, {1 << k}L, 0L)" for k, c in enumerate(conditions) if c is not None]
        return " | ".join([*bits, _APART])

    parts = [applied[k : k + WORD_BITS] for k in range(0, len(applied), WORD_BITS)]
    fails = [f"{word([f for _, f, _ in part])} AS {sql_ident(c)}" for part, c in zip(parts, out.fail_cols, strict=True)]
    # A severity counts only where its rule fails: bit by bit.
    crits = [
        f"{sql_ident(f)} & ({word([sev for _, _, sev in part])}) AS {sql_ident(c)}"
        for part, f, c in zip(parts, out.fail_cols, out.crit_cols, strict=True)
    ]
    total = " + ".join(f"bit_count({sql_ident(c)})" for c in out.fail_cols) or "0"
    flagged = df.selectExpr("*", *fails)
    tail = [f"CAST({total} AS INT) AS {sql_ident(total_col)}", f"({total}) = 0 AS {sql_ident(ok_col)}"]
    return out.with_df(flagged.selectExpr("*", *crits, *tail))


def evaluate(
    df: DataFrame,
    rules: Iterable[Rule | Mapping[str, Any]],
    *,
    on_missing: str = "error",
    threshold_mode: str = "strict",
    strict_ops: bool = True,
    total_col: str = TOTAL_COL,
    ok_col: str = OK_COL,
) -> Evaluation:
    """Evaluate a rule set over ``df`` in one lazy projection.

    Adds ``FAIL_<name>`` and ``CRIT_<name>`` per applied rule (CRIT implies
    FAIL; false without a severity layer), the per-row failure count
    ``total_col`` and ``ok_col`` (= no failure).  Rules whose failure column
    is absent are skipped and listed in ``Evaluation.skipped``.
    """
    compiled, skipped = _applied(df, rules, on_missing=on_missing, threshold_mode=threshold_mode, strict_ops=strict_ops)
    applied = [r for r, _, _ in compiled]
    _free_names(df, [*(r.fail_flag for r in applied), *(r.crit_flag for r in applied), total_col, ok_col])
    flag_exprs = [f"{fail} AS {sql_ident(r.fail_flag)}" for r, fail, _ in compiled]
    crit_exprs = []
    for r, _, sev in compiled:
        crit = f"{sql_ident(r.fail_flag)} AND ({sev})" if sev is not None else "false"
        crit_exprs.append(f"{crit} AS {sql_ident(r.crit_flag)}")
    # Two projections, each one SQL-parsed select: the flags, then the
    # severity flags, the failure count and the all-OK flag on top of them.
    flagged = df.selectExpr("*", *flag_exprs)
    total = f"CAST({balanced_sql_sum([f'CAST({sql_ident(r.fail_flag)} AS INT)' for r in applied])} AS INT)"
    out = flagged.selectExpr(
        "*",
        *crit_exprs,
        f"{total} AS {sql_ident(total_col)}",
        f"({total}) = 0 AS {sql_ident(ok_col)}",
    )
    return Evaluation(
        df=out,
        rules=applied,
        source_columns=list(df.columns),
        skipped=skipped,
        total_col=total_col,
        ok_col=ok_col,
    )
