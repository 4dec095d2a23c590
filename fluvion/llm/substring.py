"""Substring dedup by fixed-block anchors.

A passage of ``length`` words that two documents share holds, in the one, a whole block
of ``length // 2`` words that begins at a multiple of that number: the anchor. Anchors
of all documents are the index; every rolling window of as many words is a probe. Where
a probe meets an anchor of another document, the windows of ``length`` words around it
are compared, which extends the hit in both directions for as long as words agree: the
union of the agreeing windows is the maximal exact repeat.

Probes are many, so documents are dealt into chunks of a few MB and each chunk sends
its distinct probes as sorted, gap-coded fingerprints, three or four bytes each, to the task that
owns their range; the owner answers with those that met a foreign anchor. The windows
around hits go the same way, with full fingerprints and the smallest document that has
each, and come back where a smaller document elsewhere has them too. A passage that a
third of all documents share is one entry per chunk, never a list of documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvion.llm.arrays import U64, Words, buffers, runs, slices, whole
from fluvion.llm.scratch import map_batches, numbered, trim

#: Bytes of text in a chunk, and bytes of text whose probes one owner sees: these grow with the root of
#: the input from OWNER_GROWS bytes on, up to OWNER_MOST times, so that messages don't get too short.
CHUNK_BYTES, OWNER_BYTES = 4 << 20, 16 << 20
OWNER_GROWS, OWNER_MOST = 10 << 30, 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The fewest bits of a probe, and the most: their number follows the input, so that the share
#: of windows that a chance meeting makes look at stays below one in CHANCE.
PROBE_BITS, MOST_BITS, CHANCE = 40, 52, 64
#: Partitions up to which each holds one chunk, and chunks of a partition beyond.
PARTITIONS, CHUNKS_EACH = 4000, 16
_NO_DOC = np.iinfo(np.int64).max


def probe_bits(total: int, length: int) -> int:
    """Bits of a probe for a corpus of so many bytes, at six bytes a word: a window asks
    for half its words' probes and meets an anchor for every ``length // 2`` words."""
    anchors, asked = total / 6 / (length // 2), length - length // 2 + 1
    return min(MOST_BITS, max(PROBE_BITS, math.ceil(math.log2(max(1.0, anchors * asked * CHANCE)))))


def _gap_bytes(bits: int) -> int:
    return 3 if bits <= 42 else 4


def gap_coded(values: np.ndarray, size: int = 3) -> bytes:
    """Sorted distinct values: the first in eight bytes, then the gaps in ``size`` bytes
    each; a gap of 0 stands for the largest gap without a value after it."""
    if not len(values):
        return b""
    most = (1 << 8 * size) - 1
    gaps = np.diff(values.astype(np.int64))
    skips = (gaps - 1) // most
    out = np.zeros(len(gaps) + int(skips.sum()), np.int64)
    out[np.arange(len(gaps)) + np.cumsum(skips)] = gaps - skips * most
    return values[:1].astype("<u8").tobytes() + out.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def gap_decoded(data: bytes, size: int = 3) -> np.ndarray:
    if not data:
        return np.zeros(0, U64)
    first = np.frombuffer(data, "<u8", 1).astype(np.int64)
    gaps = np.zeros(((len(data) - 8) // size, 4), np.uint8)
    gaps[:, :size] = np.frombuffer(data, np.uint8, offset=8).reshape(-1, size)
    gaps = gaps.view("<u4").ravel().astype(np.int64)
    skip = gaps == 0
    later = np.cumsum(np.where(skip, (1 << 8 * size) - 1, gaps))[~skip]
    return np.concatenate((first, first + later)).astype(U64)


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class Chunk:
    """The documents of one chunk. Rows without an id keep their place without words.
    ``wide``: windows are asked for too."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, length: int, wide: bool = True):
        named = table.column(id_col).is_valid()
        texts = pc.if_else(named, table.column(text_col).cast(pa.large_string()), pa.scalar("", pa.large_string()))
        self.ids = pc.fill_null(table.column(id_col).cast(pa.int64()), _NO_DOC).to_numpy()
        self.length, self.block = length, length // 2
        found = [Words(*buffers(part.column("t")), wide=wide) for part in slices(pa.table({"t": texts}), "t")]
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.words, self.counts = join([w.prints for w in found], U64), join([w.counts for w in found], np.int64)
        self.seconds = join([w.seconds for w in found], U64) if wide else None
        self.first = np.concatenate(([0], np.cumsum(self.counts))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Position and fingerprint of every rolling window of a block's length."""
        h = runs(self.words, self.block)
        at = np.flatnonzero(whole(self.first, len(h), self.block))
        return at, h[at] >> U64(64 - bits)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position and 128-bit fingerprint (two of 64) of every full window."""
        h = runs(self.words, self.length)
        at = np.flatnonzero(whole(self.first, len(h), self.length))
        return at, h[at], runs(self.seconds, self.length)[at]


def _rows(**columns) -> pa.Table:
    return pa.table(columns)


def _owned(values: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """The owner of each fingerprint: equal ranges."""
    return ((values >> U64(bits - 32)).astype(np.int64) * owners) >> 32


def _cut(values: np.ndarray, owners: int, bits: int) -> list[tuple[int, int, int]]:
    """(owner, from, to) over sorted values."""
    cuts = np.searchsorted(_owned(values, owners, bits), np.arange(owners + 1))
    return [(p, int(a), int(b)) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def send_probes(c: Chunk, chunk: int, owners: int, bits: int) -> pa.Table:
    """chunk, owner, probes, anchors, several: the chunk's distinct probes, its anchors,
    and the anchors that more than one of its documents have as a probe."""
    at, h = c.probes(bits)
    order = np.argsort(h, kind="stable")
    sorted_h, doc = h[order], c.doc[at][order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    starts = np.flatnonzero(new)
    distinct = sorted_h[starts]
    if len(starts):
        shared = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    else:
        shared = np.zeros(0, bool)
    anchors = np.unique(h[(at - c.first[c.doc[at]]) % c.block == 0])
    several = distinct[shared]
    several = several[among(several, anchors)] if len(several) else several
    out = {k: [] for k in ("owner", "probes", "anchors", "several")}
    for (p, a, b), (_, d, e), (_, f, g) in zip(*(_cut(x, owners, bits) for x in (distinct, anchors, several))):
        if a < b:
            out["owner"].append(p)
            out["probes"].append(gap_coded(distinct[a:b], _gap_bytes(bits)))
            out["anchors"].append(anchors[d:e].tobytes())
            out["several"].append(several[f:g].tobytes())
    return _rows(chunk=pa.array([chunk] * len(out["owner"]), pa.int64()), owner=pa.array(out["owner"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("probes", "anchors", "several")})


def answer_probes(table: pa.Table, bits: int) -> pa.Table:
    """chunk, hits: of one owner's probes, those that meet an anchor and that two
    documents have, for each chunk that sent them."""
    u64 = lambda name: [np.frombuffer(x, U64) for x in table.column(name).to_pylist()]
    anchors = u64("anchors")
    index = np.unique(np.concatenate(anchors)) if anchors else np.zeros(0, U64)
    count, met = np.zeros(len(index), np.int64), []
    for data, several in zip(table.column("probes").to_pylist(), u64("several")):
        h = gap_decoded(data, _gap_bytes(bits))
        met.append(np.searchsorted(index, h[among(h, index)]))
        count[met[-1]] += 1
        count[np.searchsorted(index, several)] += 1
    live = count > 1
    hits = [index[m[live[m]]] for m in met]
    keep = pa.array([len(x) > 0 for x in hits], pa.bool_())
    return _rows(chunk=table.column("chunk"), hits=pa.array([x.tobytes() for x in hits], pa.binary())).filter(keep)


def send_windows(c: Chunk, hits: np.ndarray, chunk: int, owners: int, bits: int) -> pa.Table:
    """chunk, owner, prints, seconds, docs: the chunk's distinct windows around hits, and
    the smallest id that has each."""
    at, h = c.probes(bits)
    live = np.zeros(len(c.words) + 1, np.int64)
    live[at[among(h, hits)] + 1] = 1
    upto = np.cumsum(live)  # hits before a position
    at, h, second = c.windows()
    near = upto[at + c.length - c.block + 1] > upto[at]
    at, h, second = at[near], h[near], second[near]
    ids = c.ids[c.doc[at]]
    order = np.lexsort((ids, second, h))
    h, second, ids = h[order], second[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (second[1:] != second[:-1])
    h, second, ids = h[new], second[new], ids[new]
    out = {k: [] for k in ("owner", "prints", "seconds", "docs")}
    for p, a, b in _cut(h, owners, 64):
        if a < b:
            out["owner"].append(p)
            for k, v in (("prints", h), ("seconds", second), ("docs", ids)):
                out[k].append(v[a:b].tobytes())
    return _rows(chunk=pa.array([chunk] * len(out["owner"]), pa.int64()), owner=pa.array(out["owner"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("prints", "seconds", "docs")})


def answer_windows(table: pa.Table) -> pa.Table:
    """chunk, prints, seconds: of one owner's windows, those that a smaller document of
    another chunk has, for each chunk that has them."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    prints, seconds, docs = read("prints", U64), read("seconds", U64), read("docs", np.int64)
    sizes = [len(x) for x in prints]
    h, second, ids = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((prints, U64), (seconds, U64), (docs, np.int64)))
    order = np.lexsort((second, h))
    hs, ss = h[order], second[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(h) else ids
    earlier = np.zeros(len(h), bool)
    earlier[order] = least[np.cumsum(new) - 1] < ids[order]
    out_h, out_s, at = [], [], 0
    for n in sizes:
        e = earlier[at : at + n]
        out_h.append(h[at : at + n][e].tobytes())
        out_s.append(second[at : at + n][e].tobytes())
        at += n
    keep = pa.array([len(x) > 0 for x in out_h], pa.bool_())
    return _rows(chunk=table.column("chunk"), prints=pa.array(out_h, pa.binary()), seconds=pa.array(out_s, pa.binary())).filter(keep)


def removed_words(c: Chunk, prints: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Which words lie in a window that a smaller document has: in another chunk (those
    given) or in this one."""
    at, h, second = c.windows()
    ids = c.ids[c.doc[at]]
    order = np.lexsort((second, h))
    hs, ss, sorted_ids = h[order], second[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])
    hit = np.zeros(len(h), bool)
    if len(h):
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        elsewhere = np.zeros(len(starts), bool)
        if len(prints):
            known = np.lexsort((seconds, prints))
            prints, seconds = prints[known], seconds[known]
            first, last = np.searchsorted(prints, hs[starts], "left"), np.searchsorted(prints, hs[starts], "right")
            for step in range(int((last - first).max())):  # nearly always one
                k = np.minimum(first + step, len(prints) - 1)
                elsewhere |= (first + step < last) & (seconds[k] == ss[starts])
        hit[order] = elsewhere[group] | (np.minimum.reduceat(sorted_ids, starts)[group] < sorted_ids)
    cover = np.zeros(len(c.words) + 1, np.int64)
    np.add.at(cover, at[hit], 1)
    np.add.at(cover, at[hit] + c.length, -1)
    return np.cumsum(cover)[: len(c.words)] > 0


def without(text: bytes, drop: np.ndarray) -> bytes:
    """``text`` without the words marked, each cut up to the start of the next word; the
    spaces behind the last word stay."""
    if not drop.any():
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in spans]
    out = [text[: starts[0]]]
    for d, a, b in zip(drop.tolist(), starts, [*starts[1:], spans[-1][1]]):
        if not d:
            out.append(text[a:b])
    return b"".join([*out, text[spans[-1][1] :]])


def rewritten(table: pa.Table, text_col: str, counts: tuple[str, str], gone: np.ndarray | None, first: np.ndarray | None, layout: bool) -> pa.Table:
    """The rows with what is left of their texts, and both counts. gone: of all
    words, whose texts begin at ``first``; None: none is."""
    texts, n_words, n_removed = [], [], []
    for k, text in enumerate(table.column(text_col).to_pylist()):
        data = b"" if text is None else text.encode("utf-8")
        words = data.split()
        drop = np.zeros(len(words), bool) if gone is None else gone[first[k] : first[k + 1]]
        n_words.append(len(words))
        n_removed.append(int(drop.sum()))
        if text is None:
            texts.append(None)
        elif layout:
            texts.append(without(data, drop).strip() if n_removed[-1] else data)
        else:
            texts.append(b" ".join([w for w, d in zip(words, drop.tolist()) if not d] if n_removed[-1] else words))
    out = table.set_column(table.column_names.index(text_col), text_col, pa.array(texts, pa.binary()).cast(pa.string()))
    return out.append_column(counts[0], pa.array(n_words, pa.int64())).append_column(counts[1], pa.array(n_removed, pa.int64()))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, layout: bool = False, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Remove every word covered by a window of ``length`` words (2 at least) whose words
    also stand in a document with a smaller id. Windows are judged on the input.

    Words are runs of other than 0x20, 0x09-0x0D, unchanged. Returns all columns, the text
    replaced by the kept words joined by one space, then the ``counts`` of words before and of
    those removed (long); existing columns of these names are replaced. With ``layout`` the text keeps its own
    spaces and lines: each run of removed words is cut out with the spaces behind it, and then
    those at the text's two ends; a text that loses no word stays as it is. Other columns may have
    any names.

    A null text has no words and stays null. Rows with a null id are neither searched nor
    searched in: they keep all words. Rows with one id are one document: they don't
    remove each other's words, though each loses what a smaller id has. An empty table
    gives an empty result. Windows are compared by 128 bits, made from 128-bit hashes of the
    words. A text of any length is read whole; a task needs some 70 bytes a word of its
    longest text beside the text itself.
    """
    if length < 2:
        raise ValueError("a window has two words at least")
    wanted, found_names = [c for c in df.columns if c not in counts], counts
    rows, counts = numbered(df, wanted), ("n_words", "n_removed")
    id_col, text_col = (f"c{wanted.index(c)}" for c in (id_col, text_col))
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks, owners, bits = max(1, -(-total // CHUNK_BYTES)), max(1, round(total / (OWNER_BYTES * min(max(math.sqrt(total / OWNER_GROWS), 1), OWNER_MOST)))), probe_bits(total, length)
    names, named = list(rows.columns), rows.where(F.col(id_col).isNotNull())
    # The text is dealt by as well, so that one id on very many rows fills no chunk.
    dealt = named.withColumn("__chunk", F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)))
    # One shuffle serves all three passes over the texts.
    dealt = dealt.repartition(max(min(chunks, PARTITIONS), chunks // CHUNKS_EACH), "__chunk")
    by_chunk = lambda: dealt.groupBy("__chunk")

    def first_pass(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        trim()
        return send_probes(Chunk(table, id_col, text_col, length, wide=False), key[0].as_py(), owners, bits)

    def answer(table: pa.Table) -> pa.Table:
        return answer_probes(table, bits)

    def second_pass(key: tuple[pa.Scalar, ...], table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows or not hits.num_rows:
            return send_windows_schema.empty_table()
        trim()
        found = np.sort(np.concatenate([np.frombuffer(x, U64) for x in hits.column("hits").to_pylist()]))
        return send_windows(Chunk(table, id_col, text_col, length), found, key[0].as_py(), owners, bits)

    send_windows_schema = pa.schema([("chunk", pa.int64()), ("owner", pa.int64()), ("prints", pa.binary()), ("seconds", pa.binary()), ("docs", pa.binary())])

    def third_pass(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        trim()
        c = Chunk(table, id_col, text_col, length)
        read = lambda name, kind: np.frombuffer(b"".join(found.column(name).to_pylist()), kind)
        return rewritten(table.select(names), text_col, counts, removed_words(c, read("prints", U64), read("seconds", U64)), c.first, layout)

    def unsearched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rewritten(pa.Table.from_batches([batch]), text_col, counts, None, None, layout).to_batches()

    probes = by_chunk().applyInArrow(first_pass, "chunk long, owner long, probes binary, anchors binary, several binary")
    hits = probes.groupBy("owner").applyInArrow(answer, "chunk long, hits binary")
    windows = by_chunk().cogroup(hits.groupBy("chunk")).applyInArrow(second_pass, "chunk long, owner long, prints binary, seconds binary, docs binary")
    found = windows.groupBy("owner").applyInArrow(answer_windows, "chunk long, prints binary, seconds binary")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", `{c}` long" for c in counts)
    searched = by_chunk().cogroup(found.groupBy("chunk")).applyInArrow(third_pass, schema)
    return searched.unionByName(map_batches(rows.where(F.col(id_col).isNull()), unsearched, schema)).toDF(*wanted, *found_names)
