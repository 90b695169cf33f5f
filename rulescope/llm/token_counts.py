"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A vocabulary of scored pieces (``sentencepiece`` BPE: identity normalisation,
dummy prefix, byte fallback) defines the token count of every text.  Reading
a text from left to right, the last token of each prefix's encoding is
unique: it is the one piece that ends there and may follow the last token of
the prefix before it (two pieces may follow each other if encoding their
concatenation gives back just these two).  So a reader needs only the open
positions, those from which some piece may still be completed.  These make
the *state* of a deterministic transducer over characters; every transition
is annotated with the change of the token count.  States and transitions are
compiled when first met and shared by all texts of a Python worker.

Texts are cut into chunks.  The transducer *resets* (its state no longer
depends on what came before) at a space after a non-space and at characters
that are in no longer piece.  A chunk's state map is therefore: the text up
to its first reset, whose count depends on the state it is entered in, the
count from there to the last reset, and the text after it, which leads to the
state it is left in.  Maps compose associatively; a document's maps are
composed by a prefix scan over its chunks.  Only these maps are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import Emitter, docs_of, row_stream

#: Code points of a chunk.
CHUNK = 32_768
#: Compiled states that a worker keeps; beyond it, compiling starts afresh.
MAX_STATES = 200_000
#: Words whose path a worker remembers; cleared beyond it.
MAX_WORDS = 200_000
#: Remembered answers of the pair test; cleared beyond it.
MAX_PAIRS = 200_000

SPACE = "▁"


class _State(dict):
    """char -> (next state, change of the count); compiled on demand."""

    __slots__ = ("entries", "machine", "run")

    def __init__(self, machine: Transducer, entries: tuple, run: int = 0):
        super().__init__()
        self.machine, self.entries, self.run = machine, entries, run

    def __missing__(self, c: str) -> tuple[_State, int]:
        made = self.machine.transition(self, c)
        self[c] = made
        return made


class _Words(dict):
    """Word -> tokens of a single space and the word, a path of transitions
    from one reset to the next taken as one; remembered while few."""

    __slots__ = ("machine",)

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self[word] = self.machine.walk(self.machine.after_space[0], word) + 1
        return n


class Transducer:
    """Counts tokens of texts for one piece vocabulary.

    ``pieces``: text -> score of the pieces that may be merged; ``known``:
    single characters that are pieces of their own.
    """

    def __init__(self, pieces: dict[str, float], known: set[str]):
        self.pieces, self.known = pieces, known
        self.longest = max(map(len, pieces), default=1)
        self.mergeable = {c for p in pieces if len(p) > 1 for c in p}
        self.mergeable.add(SPACE)
        words = [p for p in pieces if p.strip(SPACE)]
        if any(SPACE in p[1:] for p in words):
            raise ValueError("a piece holds a space after its first character")
        runs = [p for p in pieces if p and not p.strip(SPACE)]
        self.widest = max(map(len, runs), default=1)
        low = max((pieces[p] for p in runs if len(p) > 1), default=float("-inf"))
        spaces = [len(self.encode(SPACE * n)) for n in range(3 * self.widest + 1)]
        if any(spaces[n + self.widest] != spaces[n] + 1 for n in range(2 * self.widest + 1)) or any(
            pieces[p] <= low for p in words if len(p) > 1
        ):
            raise ValueError("pieces of spaces only must repeat by the widest and merge last")
        # What the k-th space of a run adds, by k - 1 modulo the widest piece.
        self.adds = [spaces[k + 1] - spaces[k] for k in range(self.widest)]
        self.trie: dict = {}
        for p in words + [SPACE]:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Words()
        self.words.machine = self
        self.fresh()

    def fresh(self) -> None:
        """Forget all compiled states."""
        self.made: dict[tuple, _State] = {}
        self.start = _State(self, ((None, self.trie, 0),))
        # After k spaces (k counted modulo the widest piece of spaces): the
        # last space may be the start of a word's piece or belong to the run.
        self.after_space = [
            _State(self, ((None, self.trie[SPACE], -adds), (SPACE, self.trie, 0)), run=k + 1)
            for k, adds in enumerate(self.adds)
        ]

    def encode(self, text: str) -> list[str]:
        """Merges of the best-scored (then leftmost) pair, as the library
        does; for short strings only."""
        get, none = self.pieces.get, float("-inf")
        parts = list(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def may_follow(self, left: str | None, right: str) -> bool:
        key = (left or "", right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            want = [right] if left is None else [left, right]
            ok = self.pairs[key] = self.encode("".join(want)) == want
        return ok

    def transition(self, state: _State, c: str) -> tuple[_State, int]:
        if c == " ":
            c = SPACE
        if c == SPACE:
            if not state.run:
                return self.after_space[0], 1
            k = state.run % self.widest
            return self.after_space[k], self.adds[k]
        if c not in self.mergeable:
            return self.start, 1 if c in self.known else len(c.encode())
        entries, token, count = [], None, 0
        for before, node, gap in state.entries:
            node = node.get(c)
            if node is None:
                continue
            piece = node.get("")
            if token is None and piece is not None and self.may_follow(before, piece):
                token, count = piece, gap + 1
            if len(node) > ("" in node):
                entries.append((before, node, gap))
        if token is None:  # a single character always ends a token
            raise AssertionError(f"no token ends at {c!r}")
        if token == c and c not in self.known:
            count += len(c.encode()) - 1
        entries = [(b, n, g - count) for b, n, g in entries]
        entries.append((token, self.trie, 0))
        key = tuple((b, id(n), g) for b, n, g in entries)
        found = self.made.get(key)
        if found is None:
            found = self.made[key] = _State(self, tuple(entries))
        return found, count

    def run(self, text: str, first: bool) -> int:
        """Tokens of a text that begins at a reset; ``first``: at the very
        start, where the library puts a space before it."""
        if len(self.made) > MAX_STATES:
            self.fresh()
        if first:
            text = " " + text
        if "  " in text or SPACE in text:
            return self.walk(self.start, text)
        words = text.split(" ")
        return self.walk(self.start, words[0]) + sum(map(self.words.__getitem__, words[1:]))

    @staticmethod
    def walk(state: _State, text: str) -> int:
        n = 0
        for c in text:
            state, d = state[c]
            n += d
        return n

    def reset_at(self, text: str, i: int) -> bool:
        """A new unit begins at position i > 0 whatever came before."""
        c, before = text[i], text[i - 1]
        if c in (" ", SPACE):
            return before not in (" ", SPACE)
        return c not in self.mergeable or before not in self.mergeable and before != " "

    def chunk_map(self, text: str) -> tuple[str, int, str]:
        """(text before the first reset, tokens up to the last, text after)."""
        n = len(text)
        lo = next((i for i in range(1, n) if self.reset_at(text, i)), n)
        if lo == n:
            return text, -1, ""
        hi = next(i for i in range(n - 1, 0, -1) if self.reset_at(text, i))
        return text[:lo], self.run(text[lo:hi], False), text[hi:]


def compose(a: tuple[str, int, str], b: tuple[str, int, str], machine: Transducer) -> tuple[str, int, str]:
    """The map of two neighbouring stretches from their own (associative).
    A middle of -1 marks a stretch without reset."""
    if a[1] < 0 and b[1] < 0:
        both = machine.chunk_map(a[0] + b[0])
        return both
    if a[1] < 0:
        m = machine.chunk_map(a[0] + b[0])
        if m[1] < 0:
            return m[0], b[1], b[2]
        return m[0], m[1] + machine.run(m[2], False) + b[1], b[2]
    m = machine.chunk_map(a[2] + b[0])
    if b[1] < 0:
        if m[1] < 0:
            return a[0], a[1], m[0]
        return a[0], a[1] + machine.run(m[0], False) + m[1], m[2]
    mid = machine.run(m[0], False) if m[1] < 0 else machine.run(m[0], False) + m[1] + machine.run(m[2], False)
    return a[0], a[1] + mid + b[1], b[2]


def scan(maps: list[tuple[str, int, str]], machine: Transducer) -> list[tuple[str, int, str]]:
    """Inclusive prefix scan of the maps in log2(n) sweeps."""
    out, step = list(maps), 1
    while step < len(out):
        out = [m if i < step else compose(out[i - step], m, machine) for i, m in enumerate(out)]
        step *= 2
    return out


def total(m: tuple[str, int, str], machine: Transducer) -> int:
    """Tokens of a whole document from its composed map."""
    if not m[0]:
        return 0
    if m[1] < 0:
        return machine.run(m[0], True)
    return machine.run(m[0], True) + m[1] + machine.run(m[2], False)


@lru_cache(maxsize=4)
def load(path: str) -> Transducer:
    """The transducer of a ``sentencepiece`` BPE model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {
        sp.id_to_piece(i): sp.get_score(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    }
    return Transducer(pieces, {p for p in pieces if len(p) == 1})


def count_tokens(
    df: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text; NULL or empty text: 0, 0.

    ``doc_id`` names a document: rows that share it (or have none) count as
    rows of their own, because chunks are grouped by a row id too.
    ``model_path`` must exist on every node.
    """
    docs = docs_of(df, text, doc_id).withColumn("row", F.monotonically_increasing_id())
    last = F.greatest(F.ceil(F.length("text") / chunk).cast("int") - 1, F.lit(0))
    parts = docs.select(
        "doc_id", "row", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("text", i * chunk + 1, chunk)))
    )
    fields = [("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("n_bytes", pa.int64())]
    fields += [("head", pa.string()), ("inner", pa.int64()), ("tail", pa.string())]
    schema = pa.schema(fields)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out = load(model_path), Emitter(schema)
        for d, row, pos, t in row_stream(batches, "doc_id", "row", "pos", "col"):
            head, inner, tail = machine.chunk_map(t)
            out.add(len(head) + len(tail) + 40, d, row, pos, len(t.encode()), head, inner, tail)
            if out.full():
                yield out.batch()
        yield out.batch()

    summaries = parts.mapInArrow(
        maps, "doc_id long, row long, pos int, n_bytes long, head string, inner long, tail string"
    )
    grouped = summaries.groupBy("doc_id", "row").agg(
        F.sum("n_bytes").alias("n_bytes"),
        F.array_sort(F.collect_list(F.struct("pos", "head", "inner", "tail"))).alias("maps"),
    )
    done = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out = load(model_path), Emitter(done)
        for d, n, ms in row_stream(batches, "doc_id", "n_bytes", "maps"):
            all_maps = scan([(m["head"], m["inner"], m["tail"]) for m in ms], machine)
            out.add(24, d, n, total(all_maps[-1], machine))
            if out.full():
                yield out.batch()
        yield out.batch()

    return grouped.select("doc_id", "n_bytes", "maps").mapInArrow(composed, "doc_id long, n_bytes long, n_tokens long")
