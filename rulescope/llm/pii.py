"""Personal data by candidate spans and boosted trees, in Spark SQL only.

1. *Base rules* give spans that are always taken: e-mail addresses, IPv4
   addresses, card numbers (Luhn) and international phone numbers.
2. *Generators* with loose patterns propose further, overlapping spans.
3. Gradient-boosted trees score each proposal that fails its base rule by its
   format and its context.  They are fitted on ``PLANTS`` snippets with a known
   answer (``planted``): personal data in forms that the base rules miss, and
   look-alikes.  The context-free proposals of all documents are further
   negatives, counted by their features, so that the fit reads a row for each
   distinct combination, weighted with its count (all counts are scaled down
   alike if they outweigh the snippets); all other proposals of the documents
   are unknown and left out.
4. A threshold is calibrated for each kind on the fifth that is held out: the
   smallest score at which ``PRECISION`` of the proposals are positive.
   Proposals above it are taken if they overlap no base span and no proposal
   that scores higher.

The fitted trees become one SQL expression, so documents are read in a single
pass without a shuffle.  Offsets count code points.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import docs_of, written

#: Snippets with a known answer.
PLANTS = 6_000
TREES, DEPTH, BINS, SEED = 12, 3, 32, 7
PRECISION = 0.995

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  A match begins at a search position or where a run of
# its first characters begins, and runs are matched possessively: the same
# leftmost matches, in linear time and constant stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ \-]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
}

#: Loose patterns: (kind, pattern).
GENERATORS = (
    (
        "email",
        r"(?<![^\s<>()\[\]\"',;:])[^\s<>()\[\]\"',;:@]++ ?(?:@|\(at\)|\[at\]) ?"
        r"[^\s<>()\[\]\"',;:@.!?]++(?:[.!?]++[^\s<>()\[\]\"',;:@.!?]++)*+",
    ),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:[.,][0-9]{1,4}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ ./\-]?+[0-9])++"),
    ("phone", r"(?<![0-9A-Za-z])[+(]?[+(]?[0-9](?:[ ().\-]{0,3}+[0-9])++"),
)
#: Fewest and most digits of a proposal that is made of numbers.
DIGITS = {"card": (12, 19), "phone": (7, 15)}

#: Words before a span that point to personal data.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|node",
    "card": "card|visa|master|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|cell|fax|sms",
}
FEATURES = (
    "f_email", "f_ip", "f_card", "f_phone", "f_length", "f_digits", "f_marks", "f_plus", "f_paren", "f_luhn",
    "f_small_parts", "f_dots", "f_at", "f_domain", "f_before", "f_after", "f_context", "f_national", "f_issuer", "f_date",
)

# National phone numbers in groups; cards of 14 and 15 digits by their first ones.
NATIONAL = r"^(?:\(0[0-9]{1,4}\) ?[0-9]{3,4}[ .\-]?[0-9]{4}|(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .\-])[2-9][0-9]{2}[ .\-][0-9]{4})$"
ISSUER = r"^(?:3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11})$"
DATE = r"(?:^|[^0-9])(?:19|20)[0-9]{2}[ ./\-](?:0[1-9]|1[0-2])[ ./\-][0-3][0-9]|[0-3][0-9][ ./\-](?:0[1-9]|1[0-2])[ ./\-](?:19|20)[0-9]{2}"

_CHUNK = 256
_HIT = "array<struct<start:int,end:int,s:string>>"
_NO_HITS = f"cast(array() as {_HIT})"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, s) of the pattern's matches, from the gaps
    between them.  Positions add up chunk by chunk, so many matches cost
    no quadratic copying."""
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )

    def chunked(p: Column) -> Column:
        last = ((F.size(p) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(p, j * _CHUNK + 1, _CHUNK))

    def one(acc: Column, e: Column) -> Column:
        start = (acc["at"] + F.length(e["gap"])).cast("int")
        end = (start + F.coalesce(F.length(e["hit"]), F.lit(0))).cast("int")
        hit = F.struct(start.alias("start"), end.alias("end"), e["hit"].alias("s"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(hit)).cast(_HIT).alias("out"))

    def many(acc: Column, chunk: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.expr(_NO_HITS).alias("out"))

        def joined(inner: Column) -> Column:
            out = F.concat(acc["out"], F.array(inner["out"])).cast(f"array<{_HIT}>")
            return F.struct(inner["at"].alias("at"), out.alias("out"))

        return bound(F.aggregate(chunk, start, one), joined)

    nothing = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_HIT}>)").alias("out"))
    found = F.flatten(F.aggregate(bound(pairs, chunked), nothing, many, lambda acc: acc["out"]))
    return F.filter(found, lambda x: x["s"].isNotNull())


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled (9 taken off above 9)."""
    parts = F.transform(
        F.split(F.reverse(digits), "", -1),
        lambda c, i: F.when(c == "", 0)
        .when(i % 2 == 0, c.cast("int"))
        .when(c.cast("int") > 4, c.cast("int") * 2 - 9)
        .otherwise(c.cast("int") * 2),
    )
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def small_parts(s: Column) -> Column:
    """All numbers between dots or commas are at most 255."""

    def small(p: Column) -> Column:
        short = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(999)) <= 255)

    return F.forall(F.split(s, "[.,]", -1), small)


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> matches of the base pattern that pass their test."""

    def when(gate: Column, pattern: str) -> Column:
        return F.when(gate, matches(text, pattern)).otherwise(F.expr(_NO_HITS))

    digit = text.rlike("[0-9]")
    # A card's match holds its first digit, so a test of the digits decides.
    tests = {
        "email": (F.instr(text, "@") > 0, lambda x: F.lit(True)),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), lambda x: small_parts(x["s"])),
        "card": (
            text.rlike(r"[0-9](?:[ \-]?[0-9]){15}"),
            lambda x: F.length(digits_of(x["s"])).between(16, 19) & luhn(digits_of(x["s"])),
        ),
        "phone": (digit & (F.instr(text, "+") > 0), lambda x: F.length(digits_of(x["s"])).between(8, 15)),
    }
    return {k: F.filter(when(tests[k][0], BASE[k]), tests[k][1]) for k in KINDS}


def tagged(kind: str, hits: Column) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(hits, lambda x: F.struct(number.alias("k"), x["start"].alias("start"), x["end"].alias("end")))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds ``base``: array of (k, start, end) by kind, then start."""
    found = base_spans(F.col("text"))
    return docs.withColumn("base", F.concat(*[tagged(k, found[k]) for k in KINDS]))


def with_proposals(docs: DataFrame) -> DataFrame:
    """Adds ``proposals``: array of (k, start, end, features, positive)."""
    text = F.col("text")
    return docs.withColumn("proposals", F.concat(*[_proposed(text, kind, p) for kind, p in GENERATORS]))


def _proposed(text: Column, kind: str, pattern: str) -> Column:
    gate = text.rlike(r"@|\(at\)|\[at\]") if kind == "email" else text.rlike("[0-9]")
    low, high = DIGITS.get(kind, (0, 0))
    if high:  # a cheap test for a run that could hold enough digits
        gate = text.rlike(r"[0-9](?:[ ()./\-]{0,3}[0-9]){%d}" % (low - 1))
    hits = F.when(gate, matches(text, pattern)).otherwise(F.expr(_NO_HITS))
    if high:
        hits = F.filter(hits, lambda x: F.length(digits_of(x["s"])).between(low, high))
    return F.transform(hits, lambda x: proposal(text, kind, x))


def proposal(text: Column, kind: str, x: Column) -> Column:
    s, digits, k = x["s"], digits_of(x["s"]), KINDS.index(kind)
    before = F.lower(F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))))
    mark = lambda c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    features = {
        **{f"f_{n}": F.lit(1.0 if n == kind else 0.0) for n in KINDS},
        "f_length": F.least(F.length(s), F.lit(100)),
        "f_digits": F.least(F.length(digits), F.lit(40)),
        "f_marks": F.least(F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")), F.lit(40)),
        "f_plus": F.startswith(s, F.lit("+")),
        "f_paren": F.instr(s, "(") > 0,
        "f_luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False) if kind == "card" else F.lit(False),
        "f_small_parts": small_parts(s) if kind == "ip" else F.lit(False),
        "f_dots": F.least(mark("."), F.lit(10)),
        "f_at": F.instr(s, "@") > 0,
        "f_domain": s.rlike(r"[A-Za-z0-9\-]\.[A-Za-z]{2,}$") if kind == "email" else F.lit(False),
        "f_before": F.substring(text, x["start"], F.when(x["start"] > 0, 1).otherwise(0)).rlike("[A-Za-z0-9]"),
        "f_after": F.substring(text, x["end"] + 1, F.lit(1)).rlike("[A-Za-z0-9]"),
        "f_context": before.rlike(rf"\b(?:{CONTEXT[kind]})\b"),
        "f_national": s.rlike(NATIONAL) if kind == "phone" else F.lit(False),
        "f_issuer": digits.rlike(ISSUER) if kind == "card" else F.lit(False),
        "f_date": s.rlike(DATE) if kind in DIGITS else F.lit(False),
    }
    columns = [features[n].cast("double").alias(n) for n in FEATURES]
    passes = {
        "email": s.rlike(BASE["email"]),
        "ip": s.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & small_parts(s),
        "card": s.rlike(r"^[0-9][0-9 \-]+[0-9]$") & F.length(digits).between(16, 19) & luhn(digits),
        "phone": s.rlike(r"^\+[0-9][ ().0-9\-]+[0-9]$") & F.length(digits).between(8, 15),
    }
    same = passes[kind].alias("positive")
    return F.struct(
        F.lit(k).alias("k"), x["start"].alias("start"), x["end"].alias("end"), same, F.struct(*columns).alias("f")
    )


# --- the trees --------------------------------------------------------------------


def planted(n: int = PLANTS) -> list[tuple[int, int, int, int, str]]:
    """(number, kind or -1, start, end, text) of snippets with a known answer:
    personal data of the kind in a form its base rule misses, or, at -1, a
    look-alike that is none."""
    rng = random.Random(SEED)
    words = "the of and report table value total item order line part figure about some was more".split()
    cues = {
        "email": ["mail", "contact", "write to"],
        "ip": ["ip", "host", "server"],
        "card": ["card", "visa", "credit card no.", "payment by amex"],
        "phone": ["phone", "tel.", "call", "mobile no.", "fax"],
    }

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def checked(start: str, k: int, good: bool = True) -> str:
        """``k`` digits that pass the Luhn test, or do not."""
        body = start + digits(k - 1 - len(start))
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str((-total + (0 if good else rng.randint(1, 9))) % 10)

    def parted(s: str, sizes: tuple[int, ...], mark: str) -> str:
        out = []
        for k in sizes:
            out.append(s[:k])
            s = s[k:]
        return mark.join(x for x in [*out, s] if x)

    def area() -> str:
        return rng.choice("23456789") + digits(2)

    def address(domain: bool) -> str:
        name = rng.choice(["jo", "ann.lee", "k_" + digits(2), "info", "j-doe", "maria.x"])
        host = rng.choice(["host", "mail" + digits(1), "example", "uni-x"])
        host += rng.choice([".com", ".org", ".de", ".co.uk"]) if domain else ""
        at = rng.choice([" (at) ", "(at)", " [at] ", "[at]", " @ ", "@ ", " @"])
        return f"{name}{at}{host}"

    def number(k: int) -> str:  # a phone number that only a cue gives away
        s = digits(k)
        return rng.choice([s, parted(s, (3,), "-"), parted(s, (3,), " "), parted(s, (3, 2, 2), " "), parted(s, (4,), " "), parted(s, (2, 3), ".")])

    def date() -> str:
        d = [f"{rng.randint(1950, 2049)}", f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"]
        return rng.choice("-. ").join(d if rng.random() < 0.6 else d[::-1]) + rng.choice(["", f" {rng.randint(0, 23):02d}"])

    def octets(most: int, mark: str) -> str:
        return mark.join(str(rng.randint(0, most)) for _ in range(4))

    def card(good: bool = True) -> str:  # 12 to 15 digits
        s = checked("", rng.randint(12, 15), good)
        return rng.choice([s, parted(s, (4, 6), rng.choice(" -")), parted(s, (4, 4, 4), rng.choice(" -"))])

    def issued() -> str:
        s = rng.choice([lambda: checked(rng.choice(["34", "37"]), 15), lambda: checked(rng.choice(["36", "38", "300", "305"]), 14)])()
        return rng.choice([s, parted(s, (4, 6), rng.choice(" -"))])

    def dotted(good: bool = True) -> str:  # 16 digits by marks that the base rule does not know
        return parted(checked(rng.choice("3456"), 16, good), (4, 4, 4), rng.choice("./"))

    # (kind, personal data, cue before it: yes, no or either, text)
    forms = [
        ("email", True, None, lambda: address(True)),
        ("email", False, None, lambda: address(False)),
        ("ip", True, True, lambda: octets(255, ",")),
        ("ip", False, False, lambda: octets(255, ",")),
        ("ip", False, None, lambda: octets(999, rng.choice(".,")) + digits(1) if rng.random() < 0.5 else f"{rng.randint(256, 999)}." + octets(255, ".").rpartition(".")[0]),
        ("card", True, True, card),
        ("card", True, None, issued),
        ("card", True, None, dotted),
        ("card", False, False, card),
        ("card", False, None, lambda: card(False)),
        ("card", False, None, lambda: dotted(False)),
        ("card", False, None, lambda: checked("", rng.randint(16, 19), False)),
        ("card", False, None, lambda: checked(rng.choice(["34", "37"]), 15, False)),
        ("phone", True, None, lambda: f"({area()}) {area()}-{digits(4)}"),
        ("phone", True, None, lambda: rng.choice("-. ").join([area(), area(), digits(4)])),
        ("phone", True, None, lambda: f"(0{digits(rng.randint(1, 3))}) {digits(4)} {digits(4)}"),
        ("phone", True, True, lambda: number(rng.randint(7, 11))),
        ("phone", False, False, lambda: number(rng.randint(7, 15))),
        ("phone", False, False, lambda: digits(rng.randint(7, 15))),
        ("phone", False, False, lambda: parted(digits(9), (3, 2), "-")),
        ("phone", False, None, date),
    ]
    national = re.compile(NATIONAL)
    out = []
    while len(out) < n:
        kind, personal, cue, make = forms[len(out) % len(forms)]
        s = make()
        if not personal and (national.match(s) or re.match(ISSUER, re.sub("[^0-9]", "", s)) and kind == "card" and cue is False):
            continue  # by chance in a form that is personal data
        if personal and kind == "phone" and re.search(DATE, s):
            continue
        given = rng.random() < 0.5 if cue is None else cue
        before = " ".join(rng.choice(words) for _ in range(5)) + rng.choice([" ", ". ", ": "])
        if given:
            before += rng.choice(cues[kind]) + rng.choice([" ", ": "])
        after = rng.choice(["", ".", ", then", " and so on"])
        out.append((len(out), KINDS.index(kind) if personal else -1, len(before), len(before) + len(s), before + s + after))
    return out


def answers(docs: DataFrame) -> DataFrame:
    """Proposals of known answer that fail their base rule, counted by their
    values: kind ``k``, features, ``label``, ``held`` (held out), ``seen`` (in
    ``docs``), ``weight`` (proposals).  All documents count; those without id
    are held out by their text."""
    rows = with_proposals(docs)
    key = F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id")
    one = rows.select(key, "text", F.explode("proposals").alias("p")).where("NOT p.positive AND p.f.f_context = 0")
    plain = F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).rlike("^[0-9 ]+$")
    bare = (
        F.when(F.col("p.k") == KINDS.index("email"), F.col("p.f.f_domain") == 0)
        .when(F.col("p.k") == KINDS.index("ip"), True)
        .otherwise(plain & (F.col("p.f.f_national") == 0) & ((F.col("p.f.f_issuer") == 0) | (F.col("p.f.f_luhn") == 0)))
    )
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held")
    seen = one.where(bare).select(held, F.lit(True).alias("seen"), F.lit(0.0).alias("label"), "p.k", "p.f.*")

    names = ["doc_id", "kind", "from", "to", "text"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    cols = [pa.array(c, t) for c, t in zip(zip(*planted(), strict=True), types, strict=True)]
    known = docs.sparkSession.createDataFrame(pa.table(cols, names=names)).repartition(4)
    known = with_proposals(known).select("doc_id", "kind", "from", "to", F.explode("proposals").alias("p"))
    label = F.expr("cast(p.k = kind AND p.start = `from` AND p.end = `to` AS double)").alias("label")
    every = known.where("NOT p.positive").select(held, F.lit(False).alias("seen"), label, "p.k", "p.f.*").unionByName(seen)
    return every.groupBy(*every.columns).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def tree_sql(debug: str, prefix: str) -> str:
    """The margin of a fitted ensemble as SQL, from its printed form."""
    lines = debug.splitlines()
    trees: list[tuple[float, list[str]]] = []
    for line in lines:
        head = re.match(r"\s*Tree \d+ \(weight ([-\d.eE]+)\):", line)
        if head:
            trees.append((float(head[1]), []))
        elif trees and line.strip():
            trees[-1][1].append(line.strip())

    def read(rows: list[str]) -> str:
        row = rows.pop(0)
        leaf = re.match(r"Predict: ([-\d.eE]+)", row)
        if leaf:
            return f"{float(leaf[1])!r}D"
        test = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", row)
        low = read(rows)
        rows.pop(0)  # the matching Else
        high = read(rows)
        return f"(CASE WHEN {prefix}{FEATURES[int(test[1])]} <= {float(test[2])!r}D THEN {low} ELSE {high} END)"

    return " + ".join(f"{w!r}D * {read(rows)}" for w, rows in trees) or "0D"


def fit(docs: DataFrame) -> tuple[str, list[float]]:
    """(margin SQL over ``x.f.*``, threshold of each kind); the threshold of a
    kind for which none is precise enough is infinite."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = written(answers(docs), "pii-answers")
    train = rows.where(~F.col("held"))
    total, n = train.agg(F.sum(F.when(F.col("seen"), F.col("weight"))), F.count(F.lit(1))).first()
    fair = F.when(F.col("seen"), F.col("weight") * min(1.0, PLANTS / (total or 1.0))).otherwise(F.col("weight"))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    # Few rows, always in the same order.
    by = ["seen", "label", *FEATURES]
    data = assembler.transform(train.repartition(2, *by).sortWithinPartitions(*by))
    data = data.select("features", "label", fair.alias("fair"))
    # Of more rows than this, and than the square of its bins, Spark would
    # sample some to place the splits.
    bins = BINS if n <= 10_000 else max(BINS, math.isqrt(n) + 1)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=bins, weightCol="fair")
    model = trees.fit(data)
    margin = tree_sql(model.toDebugString, "")
    scored = rows.where("held").select("k", F.expr(margin).alias("m"), "label", "weight")
    # Every proposal counts once; the distinct scores of small trees are few.
    yes = F.sum(F.col("label") * F.col("weight")).alias("yes")
    steps = scored.groupBy("k", "m").agg(yes, F.sum("weight").alias("n")).collect()
    least = [float("inf")] * len(KINDS)
    for k in range(len(KINDS)):
        yes = n = 0.0
        for r in sorted((r for r in steps if r["k"] == k), key=lambda r: -r["m"]):
            yes, n = yes + r["yes"], n + r["n"]
            if yes >= PRECISION * n:
                least[k] = r["m"]
    return tree_sql(model.toDebugString, "x.f."), least


SPANS_DDL = "array<struct<k:int,start:int,end:int>>"


def find(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, base, spans) for every row of ``df``.

    ``base`` are the base spans, ``spans`` all spans taken (``k`` indexes
    ``KINDS``), both by kind, then start.  A NULL or empty text has none.
    """
    docs = docs_of(df, text, doc_id)
    return _found(docs, fit(docs)).select("doc_id", "text", "base", "spans")


_SPAN = "struct<start:int,end:int,k:int,m:double>"
_RUN = f"struct<run:array<{_SPAN}>,end:int,out:array<{_SPAN}>>"
_MERGED = "struct<start:int,end:int,k:int>"
_MERGE = f"struct<last:{_MERGED},out:array<{_MERGED}>>"


def chunked(items: Column) -> Column:
    """An array in pieces of ``_CHUNK`` items, one empty piece if it is empty."""
    last = (F.greatest(F.size(items) - 1, F.lit(0)) / _CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(items, j * _CHUNK + 1, _CHUNK))


def swept(items: Column, zero: Column, step: Callable[[Column, Column], Column], state: str, out: str) -> Column:
    """The fold of ``items``: (state, outs).  What ``step`` adds to the
    state's ``out`` is set aside piece by piece, so that it is not copied for
    every item."""
    whole = f"struct<state:{state},outs:array<array<{out}>>>"
    none = F.expr(f"cast(array() as array<{out}>)")

    def piece(acc: Column, chunk: Column) -> Column:
        def aside(done: Column) -> Column:
            empty = done.withField("out", none)
            return F.struct(empty.alias("state"), F.concat(acc["outs"], F.array(done["out"])).alias("outs")).cast(whole)

        return bound(F.aggregate(chunk, acc["state"], step), aside)

    start = F.struct(zero.alias("state"), F.expr(f"cast(array() as array<array<{out}>>)").alias("outs")).cast(whole)
    return F.aggregate(chunked(items), start, piece)


def cleared(scored: Column, base: Column) -> Column:
    """The scored spans that overlap no base span and no better scored one
    (higher margin, then earlier, longer, smaller kind).  Spans are swept by
    their start, and compared only within a run of overlapping ones."""
    margin = F.lit(float("inf"))  # of base spans
    given = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k"), margin.alias("m")))
    found = F.transform(scored, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k"), x["m"].alias("m")))
    items = F.array_sort(F.concat(given, found).cast(f"array<{_SPAN}>"))

    def better(y: Column, x: Column) -> Column:
        def order(s: Column) -> Column:
            return F.struct((-s["m"]).alias("m"), s["start"].alias("start"), (-s["end"]).alias("end"), s["k"].alias("k"))

        return order(y) < order(x)

    def winners(run: Column) -> Column:
        def beaten(x: Column) -> Column:
            return F.exists(run, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & better(y, x))

        return F.filter(run, lambda x: (x["m"] < margin) & ~beaten(x))

    def step(acc: Column, x: Column) -> Column:
        apart = F.struct(F.array(x).alias("run"), x["end"].alias("end"), F.concat(acc["out"], winners(acc["run"])).alias("out"))
        longer = F.struct(
            F.concat(acc["run"], F.array(x)).alias("run"), F.greatest(acc["end"], x["end"]).alias("end"), acc["out"].alias("out")
        )
        return F.when(x["start"] >= acc["end"], apart.cast(_RUN)).otherwise(longer.cast(_RUN))

    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    zero = F.struct(none.alias("run"), F.lit(0).alias("end"), none.alias("out")).cast(_RUN)
    rest = lambda done: F.concat(F.flatten(done["outs"]), winners(done["state"]["run"]))
    return F.when(F.size(scored) == 0, none).otherwise(bound(swept(items, zero, step, _RUN, _SPAN), rest))


def _found(docs: DataFrame, fitted: tuple[str, list[float]]) -> DataFrame:
    """Adds ``base`` and ``spans``."""
    margin, least = fitted
    rows = with_proposals(with_base(docs))
    floor = F.array(*[F.lit(v) for v in least])
    scored = F.expr(
        f"transform(filter(proposals, x -> NOT x.positive), x -> named_struct('k', x.k, 'start', x.start, 'end', x.end, 'm', {margin}))"
    )
    rows = rows.withColumn("scored", F.filter(scored, lambda x: x["m"] >= floor[x["k"]]))
    clear = cleared(F.col("scored"), F.col("base"))
    extra = F.transform(clear, lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end")))
    both = F.array_sort(F.concat("base", extra))
    return rows.withColumn("spans", both).drop("proposals", "scored")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat(names[x["k"]], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")),
        ),
        ",",
    )


def merged(spans: Column) -> Column:
    """Groups of overlapping spans by start: (start, end, kind of the first)."""
    items = F.array_sort(
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("far"), x["k"].alias("k")))
    )
    items = F.transform(items, lambda x: F.struct(x["start"].alias("start"), (-x["far"]).alias("end"), x["k"].alias("k")))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        closed = F.when(last["end"] > 0, F.concat(acc["out"], F.array(last))).otherwise(acc["out"])
        apart = F.struct(x.alias("last"), closed.alias("out")).cast(_MERGE)
        longer = acc.withField("last", last.withField("end", F.greatest(last["end"], x["end"]))).cast(_MERGE)
        return F.when(x["start"] >= last["end"], apart).otherwise(longer)

    first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("k"))
    zero = F.struct(first.alias("last"), F.expr(f"cast(array() as array<{_MERGED}>)").alias("out")).cast(_MERGE)
    rest = lambda done: F.concat(F.flatten(done["outs"]), F.array(done["state"]["last"]))
    return bound(swept(items, zero, step, _MERGE, _MERGED), rest)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or group of overlapping spans, replaced by
    the name of its first kind in brackets.  The text is cut at every
    ``_CHUNK``-th group, and the gaps are taken from these pieces, so that the
    work does not grow with the spans times the text."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def filled(groups: Column) -> Column:
        def piece(chunk: Column, j: Column) -> Column:
            start = F.when(j == 0, 0).otherwise(F.get(groups, j * _CHUNK - 1)["end"])
            whole = F.substring(text, start + 1, F.element_at(chunk, -1)["end"] - start)

            def parts(cut: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    before = F.when(i == 0, cut["start"]).otherwise(F.get(chunk, i - 1)["end"])
                    return F.concat(F.substring(cut["s"], before - cut["start"] + 1, x["start"] - before), names[x["k"]])

                return F.array_join(F.transform(chunk, one), "")

            return bound(F.struct(start.alias("start"), whole.alias("s")), parts)

        tail = F.substring(text, F.element_at(groups, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(chunked(groups), piece), ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(bound(merged(spans), filled))


def counts(found: DataFrame) -> DataFrame:
    """(doc_id, n_<kind>, base_sha256, spans) of ``find``'s rows."""

    def number_of(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    number = [number_of(k) for k in range(len(KINDS))]
    digest = F.sha2(span_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *number, digest, span_text(F.col("spans")).alias("spans"))




def masked(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with personal data replaced by its kind in brackets;
    all columns stay, and a column ``n_chars`` follows the text."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    docs = df.select(
        whole.alias("row"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    rows = _found(docs, fit(docs_of(df, text, doc_id)))
    new = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("row")[text])
    rows = rows.select("row", new.alias("new"))
    cols = []
    for f in df.schema:
        old = F.col("row")[f.name]
        if f.name == text:
            old = F.col("new").cast(f.dataType)
        elif f.name == "n_chars":
            old = F.when(old.isNotNull(), F.coalesce(F.length("new"), F.lit(0)).cast(f.dataType))
        cols.append(old.alias(f.name))
    return rows.select(*cols)
