"""Classifiers: held-out accuracy on planted classes, and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluvion.llm import langid, ngrams, quality, samples, toxicity

SCHEMA = "doc_id long, text string, lang string, score string"


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    languages = {k: ["".join(r.choice(c) for _ in range(r.randrange(2, 8))) for _ in range(300)] for k, c in (("aa", "abcdeäö"), ("bb", "stuvwxé"), ("cc", "mnopqñ"))}
    bad = ["rubbish", "scoundrel", "vermin"]
    rows, labels = [], []
    for i in range(1500):
        k = r.choice(list(languages))
        junk, toxic = r.random() < 0.2, r.random() < 0.15
        text = sentence(r, languages[k], r.randrange(15, 80))
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split()) if r.random() < 0.5 else " ".join(w for w in text.split()[:6] for _ in range(9))
        if toxic:
            w = text.split()
            w[r.randrange(len(w))] = r.choice(bad)
            text = " ".join(w)
        rows.append((i, text, k, "clash"))
        if i % 3:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(-1, None, None, "clash"), (-2, "", "aa", "clash"), (-3, " 123 ", None, "clash"), (None, "abc", "aa", "clash"), (-4, rows[0][1] * 300, None, "clash")]
    labels += [(-1, 1, 0), (-2, None, None), (None, 1, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, corpus):
    return spark.createDataFrame(corpus[0], SCHEMA), spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int")


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_quality(tables, corpus):
    docs, labels = tables
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(scored) == len(corpus[0]) and all(0 <= s <= 1 for s in scored.values())
    held = [(i, q) for i, q, _ in corpus[1] if i is not None and i >= 0 and fold(i, 5) == 0]
    assert np.mean([(scored[i] >= 0.3) == q for i, q in held]) > 0.97
    assert scored[-1] == scored[-2]
    kept = quality.score(docs, quality.train(docs, labels), keep_text=True)
    assert kept.columns == ["doc_id", "text", "lang", "score"]


def test_toxicity(tables, corpus):
    docs, labels = tables
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(scored) == len(corpus[0]) and all(0 <= s <= 1 for s in scored.values())
    held = [(i, t) for i, _, t in corpus[1] if i is not None and i >= 0 and fold(i, 4) == 2]
    assert np.mean([(scored[i] >= 0.3) == t for i, t in held]) > 0.95
    assert np.mean([scored[i] >= 0.3 for i, t in held if t]) > 0.9


def test_language(tables, corpus):
    docs, _ = tables
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert len(got) == len(corpus[0]) and all(0 <= s <= 1 for _, s in got.values())
    held = [(i, k) for i, _, k, _ in corpus[0] if i is not None and i >= 0 and fold(i, 3) == 1]
    assert np.mean([got[i][0] == k for i, k in held]) > 0.97
    assert {got[i] for i in (-1, -2, -3)} == {("und", 0.0)}


def test_empty_tables(spark, tables):
    docs, labels = tables
    none, unlabelled = docs.where("false"), labels.where("false")
    assert quality.score(none, quality.train(docs, labels)).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.train(docs, unlabelled)).collect()} == {0.5}
    prior = {r["score"] for r in toxicity.score(docs, toxicity.train(docs, unlabelled)).collect()}
    assert len(prior) == 1 and prior.pop() < 0.01
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert langid.predict(none, langid.train(docs)).count() == 0


def test_indicators_are_distinct_and_whole():
    texts = ["the cat the cat", "", "a", "ab ab ab ab " * 50, "é" * 4]
    found = list(ngrams.Indicators().of(pa.array(texts)))
    assert all(len(set(f.tolist())) == len(f) for f in found) and not len(found[1])
    alone = [next(ngrams.Indicators().of(pa.array([t]))) for t in texts]
    assert all(set(a.tolist()) == set(b.tolist()) for a, b in zip(found, alone))
    assert len(set(found[3].tolist()) & set(range(1 << ngrams.BITS, ngrams.SIZE))) == 6


def test_hinge_loss_fit_is_optimal():
    r = np.random.default_rng(2)
    rows = [np.sort(r.choice(30, 8, replace=False)) for _ in range(60)]
    y = np.array([int(3 in x or 5 in x) for x in rows])
    scale = r.uniform(0.5, 1.5, 30)
    w, b = quality.dual_descent(rows, scale, y, 0.5, 3000, 0)
    x = np.zeros((60, 31))
    for i, row in enumerate(rows):
        x[i, row] = scale[row]
    x[:, 30] = 1
    sign = np.where(y > 0, 1, -1)
    cost = 0.25 / np.where(y > 0, y.mean(), 1 - y.mean())
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    best = np.append(w, b)
    assert all(loss(best) <= loss(best + 1e-2 * r.normal(size=31)) for _ in range(300))


def test_network_gradient_lowers_the_loss():
    texts = pa.array([c * 60 for c in ("abab", "xyxy")] * 40)
    net = langid.fit(texts, ["p", "q"] * 40, epochs=20)
    data, offsets = langid.buffers(texts)
    start, _, used = langid.windows_of(data, offsets)
    w = langid.filled(data, start, used)
    assert (net.probabilities(w)[0::4].argmax(1) == 0).all()


def numeric(f, x, step):
    """Central differences of f by each entry of x."""
    out = np.zeros(x.size)
    for k in range(x.size):
        flat = x.reshape(-1)
        was = flat[k]
        flat[k] = was + step
        up = f()
        flat[k] = was - step
        out[k] = (up - f()) / (2 * step)
        flat[k] = was
    return out.reshape(x.shape)


def test_network_gradient():
    r = np.random.default_rng(1)
    mask = langid.filter_mask().astype(float)
    total = mask.shape[1]
    net = langid.Net(["a", "b", "c"], r.normal(0, 0.5, (256, langid.DIMENSIONS)), r.normal(0, 0.4, mask.shape) * mask, r.normal(0, 0.1, total), r.normal(0, 0.3, (total, 3)), r.normal(0, 0.1, 3))
    x, y, weight = r.integers(0, 6, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1]), r.uniform(0.5, 2, 5)
    _, g = langid.loss_and_gradient(net, x, y, weight)
    for name, array, some in (("dense", net.dense, None), ("dense_bias", net.dense_bias, None), ("filter_bias", net.filter_bias, None), ("filters", net.filters, mask), ("embedding", net.embedding[:6], None)):
        want = numeric(lambda: langid.loss_and_gradient(net, x, y, weight)[0], array, 1e-6)
        assert np.allclose(g[name][:6] if name == "embedding" else g[name], want * (1 if some is None else some), atol=1e-6), name


def test_language_windows_cover_texts_of_any_length():
    texts = ["x" * n for n in (0, 1, 127, 128, 129, 1000)] + ["é" * 100]
    data, offsets = langid.buffers(pa.array(texts))
    start, text, used = langid.windows_of(data, offsets)
    w = langid.filled(data, start, used)
    for k, t in enumerate(texts):
        assert b"".join(bytes(x[:n]) for x, n in zip(w[text == k], used[text == k])) == t.encode()
    assert all(not x[n:].any() for x, n in zip(w, used))


def risk(w, bias, x, u, prior):
    loss = lambda z: np.log1p(np.exp(z))  # noqa: E731  of calling a margin clean; -margin for toxic
    p, q = x @ w + bias, u @ w + bias
    return prior * loss(-p).mean() + max(0.0, loss(q).mean() - prior * loss(p).mean())


def test_non_negative_risk_is_minimised():
    r = np.random.default_rng(4)
    dense = lambda rows, d: np.array([np.bincount(x, minlength=d) for x in rows])
    rows_p = [np.unique(np.append(r.choice(20, 4), r.choice(3, 2))) for _ in range(60)]
    rows_u = [np.unique(r.choice(20, 5)) for _ in range(200)]
    w, b = toxicity.descend(rows_p, rows_u, 20, 0.2, 3000, 0.01, 0.0)
    x, u = dense(rows_p, 20), dense(rows_u, 20)
    best = risk(w, b, x, u, 0.2)
    assert best < risk(np.zeros(20), np.log(0.25), x, u, 0.2) - 0.01
    assert all(best <= risk(w + 0.05 * r.normal(size=20), b + 0.05 * r.normal(), x, u, 0.2) + 2e-3 for _ in range(200))


def test_non_negative_branch_keeps_the_clean_risk_up():
    # Few texts, many features: without the branch the clean part of the risk falls far below zero.
    r = np.random.default_rng(6)
    rows_p, rows_u = [r.choice(200, 6, replace=False) for _ in range(8)], [r.choice(200, 6, replace=False) for _ in range(30)]
    w, b = toxicity.descend(rows_p, rows_u, 200, 0.5, 600, 0.05, 0.0)
    soft = lambda z: np.log1p(np.exp(z))
    margin = lambda rows: np.array([w[x].sum() + b for x in rows])
    assert soft(margin(rows_u)).mean() - 0.5 * soft(margin(rows_p)).mean() > -0.1


def test_calibration_minimises_the_risk_of_held_out_margins():
    r = np.random.default_rng(7)
    p, u = r.normal(2, 1, 300), np.concatenate((r.normal(2, 1, 60), r.normal(-2, 1, 440)))
    a, b = toxicity.calibrated(p, u, 0.12)
    soft = lambda z: np.log1p(np.exp(z))
    loss = lambda a, b: soft(a * u + b).mean() - 0.12 * (a * p + b).mean() + 0.5e-2 * (a - 1) ** 2
    assert 0.05 < a < toxicity.SLOPE_MOST and all(loss(a, b) <= loss(a + da, b + db) + 1e-12 for da, db in 0.05 * r.normal(size=(100, 2)))


def test_quality_model_by_a_plain_version():
    """Ratios, weights, scale and scores against dense arrays."""
    r = random.Random(3)
    good, bad = [f"good{k}" for k in range(20)], [f"bad{k}" for k in range(20)]
    y = np.array([k % 3 > 0 for k in range(120)], int)
    texts = pa.array([" ".join(r.choice(good if k or r.random() < 0.2 else bad) for _ in range(8)) for k in y])
    model = quality.fit(texts, y)
    found = [set(f.tolist()) for f in ngrams.Indicators().of(texts)]
    order = np.random.default_rng(7).permutation(120)
    fits = np.ones(120, bool)
    fits[order[:24]] = False
    every = sorted(set().union(*found))
    dense = np.array([[f in s for f in every] for s in found], float)
    counts = np.array([dense[fits & (y == k)].sum(0) for k in (0, 1)])
    common = counts.sum(0) >= 3
    # Smoothed counts of the common features are compared as shares of all features.
    alpha, size = 1.0, ngrams.SIZE
    q, p = alpha + counts
    ratio = np.log((p / (counts[1].sum() + alpha * size)) / (q / (counts[0].sum() + alpha * size)))[common]
    x = np.c_[dense[:, common] * ratio, np.ones(120)]
    sign, cost = np.where(y > 0, 1, -1)[fits], (0.01 * 0.5 / np.where(y > 0, y[fits].mean(), 1 - y[fits].mean()))[fits]
    dual = np.zeros(fits.sum())
    for _ in range(400):  # plain coordinate ascent in a fixed order
        for i, row in enumerate(x[fits]):
            g = sign[i] * (row @ ((dual * sign) @ x[fits])) - 1
            dual[i] = min(max(dual[i] - g / (row @ row), 0), cost[i])
    w = (dual * sign) @ x[fits]
    margins = x @ w
    a, b = ngrams.platt(margins[~fits], y[~fits])
    mine = model.margins(texts, ngrams.Indicators(), model.table())
    assert np.allclose(mine, margins, atol=0.02 * np.abs(margins).max())
    assert np.allclose(ngrams.sigmoid(model.slope * mine + model.offset), ngrams.sigmoid(a * margins + b), atol=0.05)


def test_platt_minimises_the_smoothed_log_loss():
    r = np.random.default_rng(5)
    y = (r.random(200) < 0.4).astype(int)
    m = r.normal(size=200) + 1.5 * y
    a, b = ngrams.platt(m, y)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda a, b: (np.log1p(np.exp(a * m + b)) - t * (a * m + b)).sum()
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-3 for da, db in 0.1 * r.normal(size=(200, 2)))


def test_one_id_on_very_many_rows_is_one_row_of_a_sample(spark):
    docs = spark.createDataFrame([(k % 5 if k < 60 else 1, f"text {k}") for k in range(400)] + [(7, None), (None, "x"), (8, "y" * 5000)], "doc_id long, text string")
    ids = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 7, 8, 99)], "doc_id long, y int")
    got = {r["doc_id"]: (r["y"], r["__text"]) for r in samples.with_texts(docs, ids, "doc_id", "text", most_text=1000).collect()}
    assert got == {1: (1, "text 1"), 2: (0, "text 12"), 3: (1, "text 13"), 7: (1, "")}
    few = samples.with_texts(docs, ids, "doc_id", "text", most_bytes=12, most_text=1000).collect()
    assert sum(len(r["__text"]) for r in few) <= 12 and len(few) >= 1


def test_ties_and_repeated_ids(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([*rows[:300], *rows[:3] * 40, (5, "another text of five", "aa", "clash")], SCHEMA)
    marks = spark.createDataFrame([*labels, *labels[:50] * 3, (5, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for found in (quality.score(docs, quality.train(docs, marks)), toxicity.score(docs, toxicity.train(docs, marks))):
        scores = {}
        for r in found.select("doc_id", "score").collect():
            scores.setdefault(r["doc_id"], set()).add(r["score"])
        assert len(scores[5]) == 2 and all(len(s) == 1 for k, s in scores.items() if k != 5)
    assert langid.predict(docs, langid.train(docs)).count() == 300 + 120 + 1
