"""Token counts of every prefix of a text, by dynamic programming.

The tokens of a prefix end in one token only: the token t that ends there and that may stand
after the last token of the prefix before t, where two tokens may stand side by side if the
two together are encoded as these two. So the count at a place is one more than the count where
its last token begins, and one walk over the tokens that occur in a piece (found by an
automaton) gives the exact count at each of its bytes. Texts are chains of pieces, cut by
the vocabulary's pattern, and a chain's counts are sums. Two kinds of prefixes are cut
otherwise than the whole text: white space that a word follows is one piece while the
word is missing, and the beginnings of ``'re``, ``'ve`` and ``'ll`` are two pieces; both get their own
counts. A special token counts as one where it is whole, and as the text that it begins
with before.

With the steps between these counts kept, how many tokens any beginning of a text has, and how
much of a text a budget holds, are sums: nothing is encoded again.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluvion.llm.arrays import slices, strings
from fluvion.llm.bpe import MEMO_CHARS, MEMO_WORDS, byte_characters
from fluvion.llm.scratch import map_batches, numbered, quoted

#: Pairs of tokens of which a worker remembers whether they may stand side by side.
MEMO_PAIRS = 1_000_000
#: Contractions whose beginnings are two pieces. Part of the pattern.
_LONG_ENDINGS = ("'re", "'ve", "'ll")


class Counter:
    """Counts by a byte-level BPE file of the tokenizers library without a normalizer."""

    def __init__(self, path: str, pattern: str):
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        self.model, self.pattern, self.chars = tokenizer.model, regex.compile(pattern), byte_characters()
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted((a["content"] for a in added), key=len, reverse=True))) if added else None
        self.gaps = regex.compile(r"\s{2,}(?=\S)")
        alphabet, own = set(self.chars), {a["content"] for a in added}
        self.tokens = {k: t for t, k in tokenizer.get_vocab(with_added_tokens=False).items() if t not in own and set(t) <= alphabet}
        self.found = ahocorasick.Automaton()
        for k, t in self.tokens.items():
            if self._ids(t) == (k,):  # others never come out of the encoder
                self.found.add_word(t, (k, len(t)))
        self.found.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.others: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _ids(self, shown: str) -> tuple[int, ...]:
        return tuple(t.id for t in self.model.tokenize(shown))

    def _stand(self, a: int, b: int) -> bool:
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self._ids(self.tokens[a] + self.tokens[b]) == (a, b)
        return ok

    def _walk(self, piece: str) -> list[int]:
        """The count at each byte of a piece, from 0 on."""
        shown = (piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")).translate(self.chars)
        counts, last, known = [0] * (len(shown) + 1), [-1] * (len(shown) + 1), self.pairs.get
        for at, (token, length) in self.found.iter(shown):
            if last[at + 1] < 0:
                start = at + 1 - length
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    ok = known(before << 32 | token)
                    if not (self._stand(before, token) if ok is None else ok):
                        continue
                counts[at + 1], last[at + 1] = counts[start] + 1, token
        if piece in _LONG_ENDINGS:
            counts[2] = 2
        return counts

    def _steps(self, piece: str) -> bytes:
        """How the count changes with each byte of a piece, in 16 bits: a byte changes no more
        than what its last token covers, some hundred bytes."""
        memo, key = (self.later, piece[1:]) if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else (self.others, piece)
        steps = memo.get(key)
        return self._remember(memo, key, self._changes(piece)) if steps is None else steps

    def _changes(self, piece: str) -> bytes:
        counts = self._walk(piece)
        return array("h", map(int.__sub__, counts[1:], counts)).tobytes()

    @staticmethod
    def _remember(memo: dict[str, bytes], key: str, steps: bytes) -> bytes:
        if len(key) <= MEMO_CHARS:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            memo[key] = steps
        return steps

    def _chain(self, text: str) -> bytes:
        """Steps of a text, piece by piece. A space before what is no white space begins a
        piece, so what stands between single spaces can be looked up alone."""
        head, *words = text.split(" ")
        found = list(map(self.later.get, words))
        if None in found:
            for k, steps in enumerate(found):
                if steps is None:
                    word = words[k]
                    if not word or word[0].isspace():
                        return b"".join(map(self._steps, self.pattern.findall(text)))
                    # Letters alone are one piece; it may have been met since.
                    found[k] = self.later.get(word) or self._remember(self.later, word, self._changes(" " + word) if word.isalpha() else b"".join(map(self._steps, self.pattern.findall(" " + word))))
        return b"".join(map(self._steps, self.pattern.findall(head))) + b"".join(found)

    def _plain(self, text: str) -> np.ndarray:
        """The count at each code point of a text, from 0 on, special tokens being ordinary text."""
        counts = np.concatenate(([0], np.cumsum(np.frombuffer(self._chain(text), np.int16), dtype=np.int64)))
        if not text.isascii():
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            counts = counts[np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))]
        for gap in self.gaps.finditer(text):
            counts[gap.end()] = counts[gap.start()] + np.frombuffer(self._steps(gap.group()), np.int16).sum()
        return counts

    def counts(self, text: str) -> np.ndarray:
        """How many tokens each prefix of a text has: one more entry than code points."""
        if self.specials is None:
            return self._plain(text)
        out, at, before = [], 0, 0
        for special in self.specials.finditer(text):
            # Up to its last character a special token is text like other text.
            part = self._plain(text[at : special.end() - 1]) + before
            out.append(part)
            before, at = int(part[special.start() - at]) + 1, special.end()
        out.append(self._plain(text[at:]) + before)
        return np.concatenate(out) if len(out) > 1 else out[0]


@functools.lru_cache(2)
def counter(path: str, pattern: str) -> Counter:
    """One counter per vocabulary and worker process."""
    return Counter(path, pattern)


def held(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix that has at most ``limit`` tokens."""
    return int(np.flatnonzero(counts <= limit)[-1]) if limit >= 0 else 0


def count(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limits: Sequence[int] = (), steps: bool = False) -> DataFrame:
    """Exact token counts of whole texts, by prefixes.

    Returns id_col, n_bytes (UTF-8), n_tokens, fits (array, for each of ``limits`` the code points of
    the longest prefix with at most so many tokens; all for a text within the limit), and
    with ``steps`` steps (binary: little-endian 16-bit numbers, by which the count changes
    with each code point), from which upto and fitting answer.

    A null text counts as empty: no tokens. Null ids, repeated rows and ties pass through, one
    row out for each row in. Other columns are not read, whatever their names. An
    empty table gives an empty result. A text of any length is one unit of work, which
    takes some 30 bytes for each of its bytes; a piece without any border (a run of letters) of any
    length takes time in proportion. Limits are not negative.
    """
    kind, asked = df.schema[id_col].dataType.simpleString(), tuple(limits)
    if any(k < 0 for k in asked):
        raise ValueError("limits must not be negative")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            for part in slices(batch, "t"):
                texts = strings(part.column("t"))
                total, fits, kept = [], [], []
                for text in texts.to_pylist():
                    found = c.counts(text)
                    total.append(int(found[-1]))
                    fits.append([held(found, k) for k in asked])
                    if steps:
                        kept.append(np.diff(found).astype("<i2").tobytes())
                out = {"i": part.column("i"), "n_bytes": pa.compute.binary_length(texts), "n_tokens": pa.array(total, pa.int64()), "fits": pa.array(fits, pa.list_(pa.int64()))}
                if steps:
                    out["steps"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    rows = df.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).alias("t"))
    return map_batches(rows, run, f"i {kind}, n_bytes long, n_tokens long, fits array<long>" + ", steps binary" * steps).withColumnRenamed("i", id_col)


def _asked(df: DataFrame, asked_col: str, out_col: str, answer) -> DataFrame:
    names = [c for c in df.columns if c != out_col]
    rows, at, of = numbered(df, names), names.index("steps"), names.index(asked_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for steps, n in zip(batch.column(at), batch.column(of)):
                counts = None if not steps.is_valid or not n.is_valid else np.concatenate(([0], np.cumsum(np.frombuffer(steps.as_buffer(), "<i2"), dtype=np.int64)))
                made.append(None if counts is None else answer(counts, n.as_py()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], [*batch.schema.names, "answer"])

    return map_batches(rows, run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "answer long"])).toDF(*names, out_col)


def upto(df: DataFrame, chars_col: str, out_col: str = "tokens_upto") -> DataFrame:
    """Add the tokens of each text's first ``chars_col`` code points, from its steps. More
    code points than there are count as all, a negative number as none; null gives null."""
    return _asked(df, chars_col, out_col, lambda counts, n: int(counts[min(max(n, 0), len(counts) - 1)]))


def fitting(df: DataFrame, limit_col: str, out_col: str = "chars_fitting") -> DataFrame:
    """Add the code points of each text's longest prefix with at most ``limit_col`` tokens,
    from its steps. A negative limit holds nothing; null gives null."""
    return _asked(df, limit_col, out_col, held)
