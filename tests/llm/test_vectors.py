"""Vector operators against brute force."""

import numpy as np
import pytest

from fluvion.llm import topk, vectorjoin

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "clash", "clash") for i, v, k in rows], SCHEMA)


def brute_links(rows, cosine):
    good = [(i, np.array(v), k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    label = {i: i for i, _, _ in rows}
    links = dict.fromkeys(label, 0)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, v, k) in enumerate(good):
        for j, w, m in good[:a]:
            if k == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in label}


@pytest.fixture
def rows():
    r = np.random.default_rng(8)
    out, i = [], 0
    for k in range(3):
        for size, noise in ((1, 0), (1, 0), (40, 0.02), (25, 0.06), (15, 0.0), (30, 0.1)):
            base = r.normal(size=12)
            base /= np.linalg.norm(base)
            for _ in range(size):
                v = (base + noise * r.normal(size=12) / np.sqrt(12) * 3) * r.choice([1.0, 1.0, 2.5])
                out.append((int(r.integers(0, 100)) * 10000 + i, v.tolist(), k))
                i += 1
    out += [(-1, None, 0), (-2, [0.0] * 12, 0), (-3, [float("nan")] + [1.0] * 11, 0), (-4, [float("inf")] + [1.0] * 11, 1), (-5, [None] + [1.0] * 11, 1), (-6, out[0][1], None), (-7, [1.0, 2.0], 0), (-8, [1.0, 2.0], 0), (-9, [], 0)]
    return out


@pytest.mark.parametrize("cell,part,cosine", [(1024, 4096, 0.98), (10, 4096, 0.98), (10, 7, 0.98), (20, 9, 0.9)])
def test_links(spark, monkeypatch, rows, cell, part, cosine):
    monkeypatch.setattr(vectorjoin, "CELL_ROWS", cell)
    monkeypatch.setattr(vectorjoin, "PART_ROWS", part)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectorjoin.near_duplicates(table(spark, rows), cosine=cosine).collect()}
    want = brute_links(rows, cosine)
    assert got == want
    assert sum(n for n, _, _ in want.values()) > 500


def test_links_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectorjoin.near_duplicates(table(spark, [(4, v, 1), (4, v, 1), (2, v, 1), (None, v, 1)])).collect()), key=str)
    assert got == sorted([(4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (None, 0, None, True)], key=str)
    assert vectorjoin.near_duplicates(table(spark, [])).count() == 0


def brute_top(rows, asked, k):
    good = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    out = []
    for q in sorted(set(asked) & good.keys()):
        scores = sorted((-int(v @ good[q]), i) for i, v in good.items() if i != q and len(v) == len(good[q]) and len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("vectors,queries", [(8192, 1024), (20, 4)])
def test_top(spark, monkeypatch, rows, vectors, queries):
    monkeypatch.setattr(topk, "VECTOR_ROWS", vectors)
    monkeypatch.setattr(topk, "QUERY_ROWS", queries)
    rows = [*rows, *((10**7 + n, rows[3][1], 0) for n in range(30)), rows[5], (None, rows[5][1], 0)]
    df = table(spark, rows)
    asked = sorted({i for i, _, _ in rows if i is not None and (i % 7 == 0 or i >= 10**7 + 25)})
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id % 7 = 0 or vec_id >= 10000025"), k=5).collect())
    assert got == brute_top(rows, asked, 5)


def test_top_odd_tables(spark):
    empty = table(spark, [])
    some = table(spark, [(1, [1.0, -0.5], 0), (2, [0.5, 0.5], 0), (3, [0.0, 0.0], 1)])
    assert topk.search(empty, empty).count() == 0 and topk.search(some, empty).count() == 0
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(some, some.where("vec_id = 1")).collect())
    assert got == [(1, 1, 2, 1024 * 512 - 512 * 512), (1, 2, 3, 0)]


def test_an_id_with_several_vectors(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(1, a, 0), (1, b, 0), (2, [1.0, 0.01, 0.1], 0), (3, [0.0, 1.0, 0.12], 0), (4, [0.01, 1.0, 0.1], 0), (1, a, 5), (5, a, 5)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectorjoin.near_duplicates(table(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 1, 1)]


def test_pivots_leave_less_than_half_to_compare():
    r = np.random.default_rng(2)
    centres = vectorjoin.scaled(r.normal(size=(8, 64)))
    clustered = vectorjoin.scaled(centres[r.integers(0, 8, 1000)] + 0.01 * r.normal(size=(1000, 64)))
    spread = vectorjoin.scaled(r.normal(size=(200, 64)))
    for x, rows, share, most in ((clustered, 200_000, 0.2, 1.0), (spread, 200, 0.5, 7.0)):
        compared, copies = vectorjoin.outlook(x, vectorjoin.pivots_for(x, rows, 0.2), 0.2)
        assert compared < share and copies < most
    assert vectorjoin.pivots_for(spread[:1].repeat(50, axis=0), 50, 0.2, always=False) is None
    assert len(vectorjoin.pivots_for(spread[:2], 2, 0.2)) == 2


@pytest.mark.parametrize("cell", [8192, 6])
def test_cells_hold_each_near_pair_once(spark, monkeypatch, rows, cell):
    monkeypatch.setattr(vectorjoin, "CELL_ROWS", cell)  # 6: cells are cut again and again
    good = [(k, v) for _, v, k in rows if k is not None and v and len(v) == 12 and None not in v and np.isfinite(v).all() and np.any(v)]
    one = spark.createDataFrame([(str(k), 96, n, 1, bytearray(np.array(v).tobytes())) for n, (k, v) in enumerate(good)], "label string, size int, vid long, weight long, v binary")
    radius, held, home = np.sqrt(2 - 2 * 0.98), {}, []
    for c in vectorjoin.cells_of(one, radius, "<f8").collect():
        held.setdefault((c["label"], c["cell"]), []).append((c["vid"], c["mask"]))
        home += [c["vid"]] * (c["mask"] == 0)
    assert sorted(home) == list(range(len(good))) and len(held) > (20 if cell == 6 else 3)
    met = [(min(a, b), max(a, b)) for found in held.values() for n, (a, m) in enumerate(found) for b, k in found[:n] if not m & k]
    assert len(met) == len(set(met))
    x, k = vectorjoin.scaled(np.array([v for _, v in good])), np.array([k for k, _ in good])
    near = {(int(i), int(j)) for i, j in zip(*np.nonzero((x @ x.T >= 0.98) & (k[:, None] == k))) if i < j}
    assert near <= set(met) and len(near) > 500


def test_many_labels_and_single_precision(spark):
    r = np.random.default_rng(4)
    rows = [(n, r.normal(size=6).astype(np.float32).tolist(), n % 700) for n in range(2100)]
    rows += [(10_000 + n, v, k) for n, v, k in rows[::3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in vectorjoin.near_duplicates(df, cosine=0.9).collect()}
    assert got == brute_links(rows, 0.9)


def test_reading_stops_when_the_kth_is_certain(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=16).tolist(), 0) for i in range(3000)]
    df = table(spark, rows)
    vectors = df.selectExpr("vec_id AS id", "transform(embedding, x -> CAST(floor(1024 * x) AS BIGINT)) AS v").cache()
    asked = vectors.where("id < 5")
    exact = {q: sorted((-int(np.dot(np.floor(1024 * np.array(v)), np.floor(1024 * np.array(rows[q][1])))), i) for i, v, _ in rows if i != q) for q in range(5)}
    # Wide bounds around the true scores: all 2999 are candidates, few must be read.
    near = spark.createDataFrame([(q, i, float(-s) - 1e8, float(-s) + 1e5 * (1 + i % 3)) for q, found in exact.items() for s, i in found], "query_id long, id long, lower double, upper double").cache()
    best, reads = topk.read_in_order(near, vectors, asked, 10)
    got = {}
    for x in sorted(best.collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((-x["score"], x["vec_id"]))
    assert got == {q: found[:10] for q, found in exact.items()}
    assert 5 * 10 <= reads <= 5 * 200
