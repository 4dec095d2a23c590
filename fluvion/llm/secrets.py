"""Secret scans: key patterns, and a token-efficiency test for random strings.

Ordinary words compress well under a BPE vocabulary and random strings don't, so a
run of key characters with few characters per token is taken for a secret, unless
it is a known digest (hex of a usual length or cut short, a UUID) or reads as an identifier: its
groups of letters compress like words. The shorter a run, the fewer characters a token must
have; runs of letters of one case are judged more strictly than mixed ones.
The test looks at every run, also where a pattern has found a span.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvion.llm.arrays import buffers, slices, strings
from fluvion.llm.scratch import map_batches, numbered

#: The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: Candidates of the token-efficiency test, runs of key characters of this length on, and the
#: characters per token below which they are secrets: long runs; shorter ones of digits and letters
#: or capitals inside words; shorter ones that are cased like words.
RANDOM_CHARS, LONG_CHARS, PLAIN_CHARS = 12, 20, 16
LONG_RATIO, MIXED_RATIO, PLAIN_RATIO = 2.2, 1.8, 1.6
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SHORT_HEX = re.compile(r"[0-9a-f]{12,15}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", re.I)
LETTERS = re.compile(r"[A-Za-z]+")
IDENTIFIER = re.compile(r"[+/_=-]*(?:[A-Za-z]+|[0-9]{1,8})(?:[+/_=-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))*[+/_=-]*")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_HEX = _class(b"0123456789abcdef")
_KEY = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def _with_run(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """Texts that may hold a run of ``least`` bytes of a class; runs over text borders
    count too, which only costs a look at both texts."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    hit = np.zeros(len(offsets) - 1, bool)
    for s, e in zip(np.searchsorted(offsets, starts[long], "right") - 1, np.searchsorted(offsets, ends[long], "left")):
        hit[s:e] = True
    return hit


@functools.lru_cache(4)
def _vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of the pattern kinds; end exclusive, in characters."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    return found


def _efficient(s: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    return len(s) >= ratio * len(encoding.encode_ordinary(s))


def wordlike(s: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    """All groups of letters are one token or compress like words."""
    return all(_efficient(w, encoding, ratio) or len(encoding.encode_ordinary(w)) == 1 for w in LETTERS.findall(s))


def ratio_of(s: str, long: float) -> float:
    """Characters per token below which a run counts as random."""
    if len(s) >= LONG_CHARS:
        return long
    if not PLAIN.fullmatch(s):
        return min(long, MIXED_RATIO)
    return min(long, PLAIN_RATIO) if len(s) >= PLAIN_CHARS else 0.0


def random_spans(text: str, encoding: tiktoken.Encoding, ratio: float) -> list[tuple[int, int, int]]:
    found = []
    for m in RANDOM.finditer(text):
        s = m[0]
        if not LETTERS.search(s) or DIGEST.fullmatch(s) or SHORT_HEX.fullmatch(s) or _efficient(s, encoding, ratio_of(s, ratio)):
            continue
        if not (IDENTIFIER.fullmatch(s) and not PLAIN.fullmatch(s) and wordlike(s, encoding, ratio)):
            found.append((m.start(), m.end(), 3))
    return found


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every span, or spans that overlap together, replaced by ``mark``."""
    out, done = [], 0
    for start, end, _ in sorted(spans):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def scan(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = LONG_RATIO, redact: str | None = None, spans_col: str = "spans") -> DataFrame:
    """Find secrets in whole texts.

    Returns all columns of ``df`` but the text, plus ``spans_col`` (array of struct kind, start,
    end; characters, end exclusive; by start, then by kind as in KINDS). Spans of different
    kinds may overlap: what the token test finds is listed as ``random`` whether or not a
    pattern finds it too. With ``redact`` the text stays, with that mark in place of every
    span, or once for spans that overlap.

    A null text has no spans and stays null. Null ids, repeated rows and ties pass
    through: one row out for each row in. A column called ``spans_col`` is replaced. An empty
    table gives an empty result. A text of any length is read whole.
    """
    rest = [c for c in df.columns if c not in (text_col, spans_col)]
    rows = numbered(df, [*rest, text_col])
    *keeps, text_name = rows.columns
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keeps), *([f"{text_name} string"] if redact is not None else []), "spans array<struct<kind:string,start:int,end:int>>"])
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _vocabulary(path, pattern)
        for batch in batches:
            for part in slices(batch, text_name):
                column = part.column(text_name)
                data, offsets = buffers(column)
                hexes, keys = _with_run(data, offsets, _HEX, HEX_CHARS), _with_run(data, offsets, _KEY, RANDOM_CHARS)
                texts, spans = strings(column).to_pylist(), []
                for k, text in enumerate(texts):
                    found = base_spans(text)
                    if hexes[k]:
                        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
                    if keys[k]:
                        found += random_spans(text, encoding, ratio)
                    spans.append(sorted(found, key=lambda x: (x[0], x[2])))
                out = [part.column(c) for c in keeps]
                if redact is not None:
                    here = column.is_valid().to_pylist()
                    out.append(pa.array([redacted(t, s, redact) if h else None for t, s, h in zip(texts, spans, here)], pa.string()))
                out.append(pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in s] for s in spans], pa.list_(span)))
                yield pa.RecordBatch.from_arrays(out, [*keeps, *([text_name] if redact is not None else []), "spans"])

    return map_batches(rows, run, schema).toDF(*rest, *([text_col] if redact is not None else []), spans_col)


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
