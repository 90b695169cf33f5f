"""Fill-in-the-middle training texts, cut by an indexable skip list.

A text is a row of tokens: white space and the word behind it, or the white
space that ends the text.  Two cut ranks, drawn from a hash of the document's
id, part it into prefix, middle and suffix; the output puts them in another
order behind marks, so that a model learns to fill the middle.

Where a rank lies in the text is found by a skip list over the tokens.  Its
lanes hold nodes at token boundaries, one in ``2 ** FAN_BITS`` boundaries in
the lowest lane and one in ``2 ** FAN_BITS`` nodes of a lane in the lane
above, chosen by a hash of the boundary's rank, so that a task that is run
again builds the same list.  Every link carries two widths, the tokens and the
code points that it passes.  A search starts in the highest lane, follows
links while their tokens still fit below the rank, and goes one lane down; the
widths it has added up are the exact rank and position.  Below the lowest
lane it walks the few tokens up to the next node in the text itself.  The list
is built from slices of the text and holds a small part of its boundaries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import docs_of, per_row

#: One node in this power of two of the lane below.
FAN_BITS = 5
#: Code points scanned at a time.
SLICE = 1 << 16

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def boundaries(text: str, lo: int) -> np.ndarray:
    """Code points before each boundary behind a token that ends in
    ``text[lo : lo + SLICE]``."""
    hi = min(lo + SLICE, len(text))
    # One code point more shows whether a word goes on behind the slice.
    codes = np.frombuffer(text[lo : hi + 1].encode("utf-32-le"), "<u4")
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    if hi == len(text):
        blank = np.append(blank, True)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + lo + 1
    if hi == len(text) and blank[-2]:
        ends = np.append(ends, hi)
    return ends


def heights(ranks: np.ndarray) -> np.ndarray:
    """In how many lanes each rank has a node: trailing zeros of a mixed
    rank, in digits of ``FAN_BITS`` bits."""
    x = ranks.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    low = (x & (~x + np.uint64(1))).astype(np.float64)  # the lowest set bit
    return np.where(x == 0, 64, np.log2(np.maximum(low, 1))).astype(np.int64) // FAN_BITS


class SkipList:
    """The tokens of ``text``: ``n`` is their number, ``seek`` finds a rank."""

    def __init__(self, text: str):
        self.text, self.n = text, 0
        parts: list[list[np.ndarray]] = []  # of each lane, (rank, code points) of its nodes
        for lo in range(0, len(text), SLICE):
            ends = boundaries(text, lo)
            ranks = np.arange(self.n + 1, self.n + 1 + len(ends))
            self.n += len(ends)
            height = heights(ranks)
            for lane in range(int(height.max(initial=0))):
                if lane == len(parts):
                    parts.append([np.zeros((1, 2), dtype=np.int64)])  # each lane starts at the head
                at = height > lane
                parts[lane].append(np.stack([ranks[at], ends[at]], axis=1))
        nodes = [np.concatenate(p) for p in parts]
        #: Links of each lane: tokens and code points passed.
        self.widths = [np.diff(x, axis=0) for x in nodes]
        #: Where each node of a lane stands in the lane below.
        self.below = [np.searchsorted(low[:, 0], high[:, 0]) for low, high in zip(nodes, nodes[1:], strict=False)]

    def seek(self, rank: int) -> int:
        """Code points of the first ``rank`` tokens."""
        units = points = at = 0
        for lane in range(len(self.widths) - 1, -1, -1):
            widths = self.widths[lane]
            while at < len(widths) and units + widths[at, 0] <= rank:
                units += int(widths[at, 0])
                points += int(widths[at, 1])
                at += 1
            if lane:
                at = int(self.below[lane - 1][at])
        while units < rank:
            points = TOKEN.match(self.text, points).end()
            units += 1
        return points


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 from the seed and the id (none: empty)."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def arranged(doc_id: int | None, text: str, seed: int, rate: int, spm: int) -> tuple:
    """(n, form, code points of prefix and middle, output) of one text."""
    tokens = SkipList(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or h3 % 100 >= rate:
        return tokens.n, "plain", None, None, text
    a, b = sorted(tokens.seek(h % (tokens.n + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        form, output = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, output = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return tokens.n, form, a, b - a, "".join(output)


def transform(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80
) -> DataFrame:
    """One row per input row (columns: ``DDL``).

    ``rate`` percent of the texts are rearranged, ``spm`` percent of these
    with the suffix first.  A text that is empty or holds a mark stays
    ``plain``, its output is the text, and its widths are NULL.

    NULL and empty texts have no token.  Very long texts are scanned a slice
    at a time.  Repeated rows each give a row, the same for the same id and
    text; rows without an id share the draws of an empty id.  An empty table
    gives no rows.  Other columns are not read.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string())]
        + [("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
    )

    def make() -> Callable[..., tuple[int, tuple]]:
        def one(d: int | None, t: str) -> tuple[int, tuple]:
            values = arranged(d, t, seed, rate, spm)
            return len(values[-1]) + 64, (d, *values)

        return one

    return per_row(docs_of(df, text, doc_id), schema, DDL, ("doc_id", "text"), make)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from.  Marks are unambiguous: the
    text holds none, and two marks cannot overlap."""
    out = F.col(f"`{output}`")
    middle = F.locate(MIDDLE, out)

    def between(start: Column, end: Column) -> Column:
        return out.substr(start, end - start)

    def joined(first_behind: str) -> tuple[Column, Column]:
        """The part at the front, and the part behind the mark."""
        mark = F.locate(first_behind, out)
        return between(F.lit(len(MIDDLE) + 1), mark), between(mark + len(MIDDLE), middle)

    last = out.substr(middle + len(MIDDLE), F.length(out))
    prefix, suffix = joined(SUFFIX)
    psm = F.concat(prefix, last, suffix)
    suffix, prefix = joined(PREFIX)
    spm = F.concat(prefix, last, suffix)
    return F.when(F.col(f"`{form}`") == "psm", psm).when(F.col(f"`{form}`") == "spm", spm).otherwise(out)
