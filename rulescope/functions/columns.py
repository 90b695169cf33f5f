"""Column helpers shared by every rule and view.

Everything here is built from Spark's built-in functions, either as a
``Column`` or as Spark SQL text (``*_sql`` builders, used by the rule
compiler), so it stays inside whole-stage codegen; nothing runs in Python
per row.

The text/number semantics follow the behaviour the rule engines were written
against (pandas ``str.lower().str.strip()`` and ``to_numeric(errors=
"coerce")``), with one deliberate change: missing stays NULL instead of
turning into the text ``'nan'``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token lists of the yes/no/ok tests of the original dashboards.
YES_TOKENS = ("yes", "y", "true", "ok")
OK_TOKENS = ("OK", "y", "true", "ok")
NO_TOKENS = ("no", "n", "false")

# The text forms pandas' numeric parser accepts.
NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_TEXT = r"^[+-]?inf(inity)?$"

# Characters Python's str.strip() removes (derived, not listed), and the
# ASCII part of that set.  Spark's btrim scans its trim string for every edge
# character, so the short ASCII set is trimmed first and the full set only
# when an edge character is non-ASCII.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())
PY_WHITESPACE_ASCII = "".join(ch for ch in PY_WHITESPACE if ord(ch) < 128)
# ASCII whitespace only: pandas rejects numbers padded with e.g. no-break
# spaces, so the number parser strips just these six characters.
ASCII_WHITESPACE = " \t\n\x0b\x0c\r"

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)


def qcol(name: str) -> Column:
    """Reference a column whose name may contain spaces, dots, `/`, `(`...

    Backticks make Spark treat the whole text as one identifier; embedded
    backticks are doubled.
    """
    return F.col("`" + name.replace("`", "``") + "`")


def as_col(c: Column | str) -> Column:
    return qcol(c) if isinstance(c, str) else c


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


# --------------------------------------------------------------------------
# Spark SQL text builders.  Rule conditions are compiled to SQL text and
# turned into Columns with one F.expr call each: far fewer driver round trips
# than composing Column objects, which matters for rule sets of hundreds of
# rules.  The Column helpers below wrap the same text, so there is one
# definition of every semantic.
# --------------------------------------------------------------------------


def sql_ident(name: str) -> str:
    """A column reference for SQL text (backticks doubled inside)."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(value: object) -> str:
    """A SQL string literal: backslash, quote and control characters are
    escaped (Spark unescapes ``\\uXXXX`` in string literals)."""
    out = []
    for ch in str(value):
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'":
            out.append("\\'")
        elif ord(ch) < 32 or ord(ch) == 127:
            out.append("\\u%04x" % ord(ch))
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def sql_double(value: float) -> str:
    """A DOUBLE literal (finite values only)."""
    return repr(float(value)) + "D"


def sql_list(values: Iterable[object]) -> str:
    return ", ".join(sql_str(v) for v in values)


def strip_sql(expr: str) -> str:
    """Python ``str.strip()``: trim the short ASCII set first and the full
    Unicode set only when an edge character is non-ASCII."""
    t = f"btrim(CAST({expr} AS STRING), {sql_str(PY_WHITESPACE_ASCII)})"
    return (
        f"(CASE WHEN ascii({t}) > 127 OR ascii(substring({t}, -1, 1)) > 127 "
        f"THEN btrim({t}, {sql_str(PY_WHITESPACE)}) ELSE {t} END)"
    )


def norm_sql(expr: str) -> str:
    return f"lower({strip_sql(expr)})"


def num_sql(expr: str, dtype: T.DataType | None = None) -> str:
    """pandas ``to_numeric(errors="coerce")`` as SQL text (see :func:`num`)."""
    if dtype is not None and is_numeric_type(dtype):
        return f"nullif(CAST({expr} AS DOUBLE), CAST('NaN' AS DOUBLE))"
    if dtype is not None and isinstance(dtype, T.BooleanType):
        return f"CAST({expr} AS DOUBLE)"
    text = f"CAST({expr} AS STRING)"
    stripped = f"btrim({text}, {sql_str(ASCII_WHITESPACE)})"
    finite = (
        f"nullif(nullif(try_cast({stripped} AS DOUBLE), CAST('Infinity' AS DOUBLE)), "
        f"CAST('-Infinity' AS DOUBLE))"
    )
    return (
        f"(CASE WHEN {stripped} RLIKE {sql_str(NUMBER_TEXT)} THEN {finite} "
        f"WHEN lower({text}) RLIKE {sql_str(INFINITY_TEXT)} THEN try_cast({text} AS DOUBLE) END)"
    )


def in_tokens_sql(expr: str, tokens: Iterable[str]) -> str:
    """Normalised membership; NULL -> NULL; an empty token list -> false."""
    values = sorted({norm_value(t) for t in tokens})
    return f"({norm_sql(expr)} IN ({sql_list(values)}))" if values else "false"


def pct_sql(n: str, total: str) -> str:
    """``n / total * 100`` as DOUBLE with a zero guard (same IEEE steps as
    :func:`pct`)."""
    return (
        f"(CASE WHEN {total} > 0 THEN CAST({n} AS DOUBLE) / CAST({total} AS DOUBLE) * 100.0D "
        f"ELSE 0.0D END)"
    )


def fixed1_sql(expr: str) -> str:
    """Python's ``f"{x:.1f}"`` for a non-negative DOUBLE: the *binary* value
    is rounded to one decimal, half to even only on exact ties (so 0.05,
    stored a little above 0.05, gives ``0.1``; Spark's ``bround`` works on
    the shortest decimal form and gives ``0.0``).

    Exact, with double arithmetic only.  With q = floor(10x), x is compared
    with the tie (2q+1)/20: against t, the double nearest that tie, when
    x != t (then the sign is exact); when x == t, by whether t lies above or
    below the decimal tie, i.e. the sign of t*20 - (2q+1), where t*20 =
    t*16 + t*4 is summed exactly (two-sum: value plus rounding error) and
    (2q+1) - sum is exact (the operands are within a factor of two).  A
    floor that is off by one next to a boundary still yields the nearest
    digit.
    """
    def let(value: str, var: str, body: str) -> str:
        # bind ``value`` once to ``var`` (a lambda variable) inside ``body``
        return f"element_at(transform(array({value}), {var} -> {body}), 1)"

    err = "((p.a - (s - (s - p.a))) + (p.b - (s - p.a)))"  # two-sum error of p.a + p.b
    at_tie = f"CASE WHEN {err} > m - s THEN 1 WHEN {err} < m - s THEN 0 ELSE q % 2 END"
    up = f"CASE WHEN x > t THEN 1 WHEN x < t THEN 0 ELSE {let('p.a + p.b', 's', at_tie)} END"
    v = f"q + {let('named_struct(' + chr(39) + 'a' + chr(39) + ', t * 16.0D, ' + chr(39) + 'b' + chr(39) + ', t * 4.0D)', 'p', up)}"
    text = f"CAST(CAST({v} AS DECIMAL(20,0)) * CAST(0.1 AS DECIMAL(2,1)) AS STRING)"
    body = let("m / 20.0D", "t", text)
    body = let("2.0D * q + 1.0D", "m", body)
    body = let("floor(x * 10.0D)", "q", body)
    return let(f"CAST({expr} AS DOUBLE)", "x", body)


def balanced_sql_sum(terms: list[str]) -> str:
    """``a + b + ...`` parenthesised as a balanced tree (shallow plans)."""
    if not terms:
        return "0"
    while len(terms) > 1:
        nxt = [f"({terms[i]} + {terms[i + 1]})" for i in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0]


# --------------------------------------------------------------------------
# Column helpers (take column names)
# --------------------------------------------------------------------------


def norm(name: str) -> Column:
    """Case-fold and strip all (Unicode) whitespace at both ends; NULL stays NULL."""
    return F.expr(norm_sql(sql_ident(name)))


def norm_value(v: object) -> str:
    """Driver-side twin of :func:`norm` for rule literals."""
    return str(v).strip().lower()


def num(name: str, dtype: T.DataType | None = None) -> Column:
    """Coerce to DOUBLE the way ``pandas.to_numeric(errors="coerce")`` does.

    Unparseable text, NaN and out-of-range values become NULL.  A bare
    ``try_cast`` is not enough: Spark accepts ``'1d'`` / ``'1f'`` suffixes and
    turns ``'1e400'`` into infinity.  Pass ``dtype`` when the column type is
    known; numeric columns then skip the text path entirely.
    """
    return F.expr(num_sql(sql_ident(name), dtype))


def is_yes(name: str) -> Column:
    return F.expr(f"coalesce({in_tokens_sql(sql_ident(name), YES_TOKENS)}, false)")


def is_ok_token(name: str) -> Column:
    return F.expr(f"coalesce({in_tokens_sql(sql_ident(name), OK_TOKENS)}, false)")


def is_no(name: str) -> Column:
    return F.expr(f"coalesce({in_tokens_sql(sql_ident(name), NO_TOKENS)}, false)")


def pct(n: Column, total: Column) -> Column:
    """``n / total * 100`` with a zero guard (ANSI mode raises on x/0)."""
    return F.when(total > 0, n.cast("double") / total.cast("double") * F.lit(100.0)).otherwise(
        F.lit(0.0)
    )


def round_half_even(x: Column, digits: int = 1) -> Column:
    """numpy-style rounding (12.25 -> 12.2)."""
    return F.bround(x, digits)


def pct_text(x: Column, digits: int = 1) -> Column:
    """Percentage label of the tables: half-even rounded (numpy), as text,
    with a trailing ``%``."""
    return F.concat(round_half_even(x, digits).cast("string"), F.lit("%"))


def pct_card_text(n: str, total: str) -> Column:
    """Percentage label of the summary cards: ``n / total * 100`` formatted
    like Python's ``f"{x:.1f}%"`` (see :func:`fixed1_sql`); arguments are
    column names."""
    return F.expr(f"concat({fixed1_sql(pct_sql(sql_ident(n), sql_ident(total)))}, '%')")


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def prefix_label(
    c: Column | str,
    prefixes: list[tuple[str, str]],
    default: str,
) -> Column:
    """Label a row by the (case-insensitive) prefix of an id column.

    ``prefixes`` is an ordered list of ``(prefix, label)``; the first match
    wins, ``default`` otherwise (NULL ids get the default too).
    """
    up = F.upper(as_col(c).cast("string"))
    expr = None
    for prefix, label in prefixes:
        cond = F.coalesce(up.startswith(prefix.upper()), F.lit(False))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


# Region labels by site-id prefix used by the rule dashboards.
CIRCLE_PREFIXES = [("B", "Bihar"), ("J", "Jharkhand")]
CIRCLE_DEFAULT = "Other"
