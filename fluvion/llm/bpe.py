"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut into pieces by the vocabulary's pattern; each piece's bytes are written
as the byte-level alphabet's characters and merged by the library's BPE model. Most
words of a corpus recur, so a worker keeps the ids of the words it has met (in a table
of bounded size; it changes no result), and texts are assembled from these.

The memo's unit is what stands between two single spaces. A space before a character
that is not white space always begins a new piece, so units can be encoded alone; texts
with other white space around their spaces take the pattern over the whole text.
"""

from __future__ import annotations

import base64
import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluvion.llm.arrays import slices, strings
from fluvion.llm.scratch import map_batches, numbered

#: Words that each of a worker's memos holds before it is emptied, and the longest such word.
MEMO_WORDS, MEMO_CHARS = 400_000, 64


def byte_characters() -> str:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(more)) for b in range(256))


def _from_ranks(path: str) -> Tokenizer:
    """A BPE model that merges as the rank file says: every split of a token into two
    tokens is a merge, of the token's rank; a piece that is a token is taken whole."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    chars = byte_characters()
    shown = {t: t.decode("latin-1").translate(chars) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        splits = [(token[:k], token[k:]) for k in range(1, len(token))]
        splits = sorted((p for p in splits if p[0] in ranks and p[1] in ranks), key=lambda p: (ranks[p[0]], ranks[p[1]]))
        merges += [[shown[a], shown[b]] for a, b in splits]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {shown[t]: r for t, r in ranks.items()}, "merges": merges}
    return Tokenizer.from_str(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model}))


class Codec:
    """Encodes and decodes by a vocabulary file: ``.tiktoken`` ranks or a tokenizers
    ``.json``, whose special tokens' strings are ordinary text here."""

    def __init__(self, path: str, pattern: str):
        tokenizer = _from_ranks(path) if path.endswith(".tiktoken") else Tokenizer.from_file(path)
        self.model, self.pattern = tokenizer.model, regex.compile(pattern)
        self.chars = byte_characters()
        back = {c: b for b, c in enumerate(self.chars)}
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.table: list[bytes] = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for shown, k in vocabulary.items():
            # A token outside the alphabet (a special one) stands for its own UTF-8 bytes.
            self.table[k] = bytes(back[c] for c in shown) if all(c in back for c in shown) else shown.encode()
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        # Ids of words after a space, of other pieces, and of what texts open with.
        self.others: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.opening: dict[str, bytes] = {}

    def _remember(self, memo: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(key) <= MEMO_CHARS:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            memo[key] = ids
        return ids

    def _merged(self, piece: str) -> bytes:
        shown = (piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")).translate(self.chars)
        return array("I", [token.id for token in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Of one match of the pattern. One that begins with a space is a word of ``later``."""
        memo, key = (self.later, piece[1:]) if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else (self.others, piece)
        ids = memo.get(key)
        return self._remember(memo, key, self._merged(piece)) if ids is None else ids

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        head, *words = text.split(" ")
        memo = self.later
        found = list(map(memo.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    word = words[k]
                    if not word or word[0].isspace():  # never in the memo
                        return self._pieces(text)
                    # Letters alone are one piece; it may have been met since.
                    found[k] = memo.get(word) or self._remember(memo, word, self._merged(" " + word) if word.isalpha() else self._pieces(" " + word))
        first = self.opening.get(head)
        if first is None:
            first = self._remember(self.opening, head, self._pieces(head))
        return first + b"".join(found)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids. A character that several tokens share comes
        out whole; ids outside the vocabulary raise IndexError."""
        if len(ids) and int(ids.min()) < 0:
            raise IndexError("negative token id")
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Of each id, the byte position at which it ends."""
        return np.cumsum(self.lengths[ids])


@functools.lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per vocabulary and worker process."""
    return Codec(path, pattern)


def character_spans(text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From byte ends to spans in characters: start of the first and end of the last
    character that a token has a byte of. Tokens that share a character overlap in it."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    upto = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    starts = np.concatenate(([0], ends)).astype(np.int64)[:-1]
    # The character of byte b is the count of first bytes up to and with b, less one.
    return upto[starts + 1] - 1, upto[ends]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Encode whole texts.

    Returns id_col, n_tokens (long) and ids (binary: little-endian unsigned 32-bit
    integers); with ``offsets`` also byte_ends, char_starts, char_ends (arrays of int);
    with ``decoded`` also decoded (binary), what decoding the ids gives back.

    A null text counts as empty: no tokens, empty ids. Null ids, repeated rows and ties
    pass through, one row out for each row in. Other columns are not read, whatever
    their names. An empty table gives an empty result. A very long text is one unit of
    work and bounded only by its own length.
    """
    kind = df.schema[id_col].dataType.simpleString()
    more = ", byte_ends array<int>, char_starts array<int>, char_ends array<int>" * offsets + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "t"):
                texts = strings(part.column("t")).to_pylist()
                coded = [c.encode(t) for t in texts]
                out = {"i": part.column("i"), "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64()), "ids": pa.array(coded, pa.binary())}
                if offsets or decoded:
                    ids = [np.frombuffer(x, "<u4") for x in coded]
                if offsets:
                    ends = [c.ends(x) for x in ids]
                    spans = [character_spans(t, e) for t, e in zip(texts, ends)]
                    for name, values in (("byte_ends", ends), ("char_starts", [s[0] for s in spans]), ("char_ends", [s[1] for s in spans])):
                        out[name] = pa.array([v.astype(np.int32) for v in values], pa.list_(pa.int32()))
                if decoded:
                    out["decoded"] = pa.array([c.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return map_batches(rows, run, f"i {kind}, n_tokens long, ids binary{more}").withColumnRenamed("i", id_col)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col`` (binary): the bytes that the ids in ``ids_col`` stand for, each id
    by the byte table, so that characters split between tokens come out whole.

    Null ids give null; empty ids give no bytes; a token id outside the vocabulary fails
    the job. All columns stay; an existing ``out_col`` is replaced.
    """
    names = [c for c in df.columns if c != out_col]
    rows, at = numbered(df, names), names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = batch.column(at).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else c.decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary"
    return map_batches(rows, run, schema).toDF(*names, out_col)
