"""Token ids by the ``tokenizers`` library, one call for many new words.

The vocabularies used here cut a text before every single space that a
non-space follows and on both sides of a line end between non-spaces, so such
*units* are encoded independently and their ids remembered.  New units made
of letters (and one punctuation mark) go to the library's merge model, other
new units to its whole pipeline together, separated by a special token.
Texts that hold a special token's own string are handed over whole.  Where a
test at loading shows that merging by rank gives the same ids, texts or words
are merged by the faster rank-based encoder instead.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np

#: Units that a worker remembers; cleared beyond it.
MAX_UNITS = 700_000

# The printable character by which byte-level vocabularies spell each byte.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHER = [b for b in range(256) if b not in _PRINTED]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(_OTHER)}
_SPELLED = [chr(_BYTE_CHARS.get(b, b)) for b in range(256)]

# Two spaces in a row, spaces beside a line end, and all rarer spaces.
# The byte-level pre-tokeniser's pattern for texts without those.
_SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_ODD = ["  ", " \n", "\n ", "\n\n"] + [
    chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"
]
_BEFORE_WORD = re.compile(r"(?= \S)")


class UnitEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.mark = self.special[-1] if self.special else None
        self.mark_id = self.tok.token_to_id(self.mark) if self.mark else None
        self.model, self.normalizer = self.tok.model, self.tok.normalizer
        self.ends = {c: self.whole(c) for c in ".,!?;:"}
        self.merger = self.ender = None
        self.newline = self.whole("\n")
        self.drops_space = not self.whole(" ")
        # Lower case, composed and with simple spaces: what the normaliser
        # makes of a Latin-1 word is the word in lower case.
        latin = "".join(map(chr, [*range(65, 91), *range(192, 256)]))
        self.folds = self.normalizer is not None and self.normalizer.normalize_str(latin) == latin.lower()
        self.spaced: dict[str, bytes] = {}  # word -> ids of " " + word
        # ids of the string itself; the same where white space is dropped
        self.plain: dict[str, bytes] = self.spaced if self.drops_space else {}
        self.merger = self._merger(path)
        self.ender = self._ender(path)

    def folded(self, text: str) -> str:
        """A Latin-1 text in lower case, unless that makes a special token."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(s in low for s in self.special) else low

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _one_run(self, word: str) -> bool:
        """Letters only, also once normalised: then a mark after the word is
        a pre-token of its own."""
        if not word.isalpha():
            return False
        if self.normalizer is None or word.isascii() or self.folds and max(word) < "\u0100":
            return True
        return self.normalizer.normalize_str(word).isalpha()

    def _letters(self, words: list[str], prefix: str) -> list[bytes]:
        """Ids of runs of letters, each one pre-token: normalised and spelled
        in the vocabulary's byte characters, then merged."""
        if self.normalizer is not None:
            plain = [w.lower() if w.isascii() or self.folds and max(w) < "\u0100" else None for w in words]
            words = [self.normalizer.normalize_str(w) if p is None else p for w, p in zip(words, plain, strict=True)]
        if self.ender is not None:
            return self._ended(words)
        if self.drops_space:
            prefix = ""
        spelled = ["".join(map(_SPELLED.__getitem__, (prefix + w).encode())) for w in words]
        return [array("I", [t.id for t in self.model.tokenize(x)]).tobytes() for x in spelled]

    def _ended(self, words: list[str]) -> list[bytes]:
        """As the merge model, for a vocabulary that marks word ends: byte b
        is spelled U+0100 + b, at the end of a word U+0200 + b."""
        enc, ids, final = self.ender
        raw = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        letters = np.flatnonzero(raw != 10)
        byte, last = raw[letters], raw[letters + 1] == 10
        spelled = np.empty((len(letters), 2), dtype=np.uint8)
        spelled[:, 0] = np.where(last, 0xC8, 0xC4) + (byte >> 6)
        spelled[:, 1] = 0x80 | (byte & 0x3F)
        ranks = np.array(enc.encode_ordinary(spelled.tobytes().decode()), dtype=np.int64)
        out = ids[ranks].tobytes()
        ends = (4 * (np.flatnonzero(final[ranks]) + 1)).tolist()
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _ender(self, path: str):
        """(encoding, ids by rank, whether a rank ends a word) or None; the
        same test as for ``_merger``, on symbols that may end a word."""
        suffix = self.model.end_of_word_suffix
        if not suffix or not self.drops_space:
            return None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        if spec.get("continuing_subword_prefix") or spec.get("unk_token") or spec.get("dropout"):
            return None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        order = {m: i for i, m in enumerate(merges)}
        code = {c: chr(0x100 + b) for b, c in enumerate(_SPELLED)}
        code |= {c + suffix: chr(0x200 + b) for b, c in enumerate(_SPELLED)}
        tokens = [*code, *["".join(m) for m in merges]]
        if len(set(tokens)) != len(tokens) or not set(tokens) <= spec["vocab"].keys():
            return None

        def symbols(token: str) -> list[str]:
            if token.endswith(suffix):
                body = list(token[: -len(suffix)])
                return [*body[:-1], body[-1] + suffix]
            return list(token)

        for token in tokens[len(code) :]:
            parts = symbols(token)
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), len(order)))
                if (parts[best], parts[best + 1]) not in order:
                    return None
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if parts != [token]:
                return None
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {"".join(code[x] for x in symbols(t)).encode(): 256 + i for i, t in enumerate(tokens)}
        enc = tiktoken.Encoding("ends", pat_str="[^\u0200-\u02ff]*[\u0200-\u02ff]", mergeable_ranks=ranks, special_tokens={})
        ids = np.array([0] * 256 + [spec["vocab"][t] for t in tokens], dtype="<u4")
        return enc, ids, np.array([False] * 256 + [t.endswith(suffix) for t in tokens])

    def _merger(self, path: str):
        """(encoding, ids by rank) that merges by rank, or None.

        Merging any neighbours whose concatenation is the best-ranked token
        equals merging by the vocabulary's own list of pairs if every token
        is what the list makes of its own spelling: inside a token's span,
        merges come in the same order as in the token alone, so the last pair
        before it is always the listed one.  That is tested for every token.
        """
        if self.normalizer is not None or self.drops_space or self.model.end_of_word_suffix:
            return None
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        kind, spec = whole["pre_tokenizer"], whole["model"]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex"):
            return None
        byte_of = {chr(c): b for b, c in ({b: b for b in _PRINTED} | _BYTE_CHARS).items()}
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["merges"]]
        spelled = sorted(byte_of, key=byte_of.__getitem__) + made
        if len(set(spelled)) != len(spelled) or not set(spelled) <= spec["vocab"].keys():
            return None
        if any([t.value for t in self.model.tokenize(x)] != [x] for x in spelled):
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in x): i for i, x in enumerate(spelled)}
        enc = tiktoken.Encoding("merges", pat_str=_SIMPLE, mergeable_ranks=ranks, special_tokens={})
        return enc, np.array([spec["vocab"][x] for x in spelled], dtype="<u4")

    def _merged(self, text: str) -> bytes:
        """Ids by rank; odd spaces and special tokens go to the library."""
        if any(s in text for s in self.special) or any(c in text for c in _ODD) or text[-1:] in (" ", "\n"):
            return self.whole(text)
        enc, ids = self.merger
        return ids[np.array(enc.encode_ordinary(text), dtype=np.uint32)].tobytes()

    def _learn(self, memo: dict[str, bytes], new: list[str], prefix: str) -> None:
        hard, runs = [], {}
        for u in new:
            word = u[:-1] if u[-1:] in self.ends else u
            if not self._one_run(word):
                hard.append(u)
            elif word not in memo:
                runs[word] = None
        if runs:
            words = list(runs)
            memo.update(zip(words, self._letters(words, prefix), strict=True))
        for u in new:
            if u not in memo and u[-1:] in self.ends and u[:-1] in memo and self._one_run(u[:-1]):
                memo[u] = memo[u[:-1]] + self.ends[u[-1]]
        for lo in range(0, len(hard), 20_000):
            part = hard[lo : lo + 20_000]
            joined = self.mark.join([prefix + u for u in part])
            ids = np.array(self.tok.encode(joined, add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) + 1 != len(part):
                raise AssertionError("a unit holds a special token")
            raw = ids.tobytes()
            lows = [0, *(4 * (cuts + 1)).tolist()]
            highs = [*(4 * cuts).tolist(), len(raw)]
            memo.update(zip(part, [raw[a:b] for a, b in zip(lows, highs, strict=True)], strict=True))

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        if self.mark is None:
            return [self.whole(t) for t in texts]
        for memo in (self.spaced, self.plain):
            if len(memo) > MAX_UNITS:  # keep the first met: mostly the frequent ones
                first = dict(islice(memo.items(), MAX_UNITS // 4))
                memo.clear()
                memo.update(first)
        spaced, plain = self.spaced.get, self.plain.get
        if self.merger is not None:
            return [self._merged(t) for t in texts]
        found: list[list[bytes | None] | None] = []
        missing: list[tuple[list, dict, str, int, str]] = []
        for t in texts:
            if any(s in t for s in self.special):
                found.append(None)
                continue
            if self.folds:
                t = self.folded(t)
            got: list[bytes | None] = []
            if any(c in t for c in _ODD):
                units = _BEFORE_WORD.split(t)
                got = list(map(plain, units))
                missing += [(got, self.plain, "", i, units[i]) for i, x in enumerate(got) if x is None]
                found.append(got)
                continue
            for line in [t.replace("\n", " ")] if self.drops_space else t.split("\n"):
                first, *words = line.split(" ")
                at = len(got)
                got.append(plain(first))
                got.extend(map(spaced, words))
                got.append(self.newline)
                if got[at] is None:
                    missing.append((got, self.plain, "", at, first))
                if None in got[at + 1 :]:
                    missing += [
                        (got, self.spaced, " ", at + 1 + i, w) for i, w in enumerate(words) if got[at + 1 + i] is None
                    ]
            got.pop()
            found.append(got)
        if missing:
            for prefix in ("", " "):
                new = dict.fromkeys([m[4] for m in missing if m[2] == prefix])
                self._learn(self.spaced if prefix else self.plain, list(new), prefix)
            for got, memo, _, i, unit in missing:
                got[i] = memo[unit]
        return [self.whole(t) if got is None else b"".join(got) for t, got in zip(texts, found, strict=True)]


@lru_cache(maxsize=4)
def load(path: str) -> UnitEncoder:
    return UnitEncoder(path)
