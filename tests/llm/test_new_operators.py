"""Fill-in-middle, resampling and token counts against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter as Tally

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluvion.llm import counts, middle, resample

FIFTY = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, `i` string, `t` long, `a.b` string, `task` int"
ODD = [None, "", " ", "\n", "\n\n", "a", "a\n", "\x01\x02\x01m\n\x02e", "\x02m\n\x02\n", "<P>\n", "x<S>y\nz", "é\n日本\n\n🙂", "tail  \n\n end", "$0\n\\1\n", "no feed " * 40]


def rows_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in zip(ids, texts)], SCHEMA)


# Fill-in-middle


def plain_middle(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.mark.parametrize("percent,spm", [(100, 50), (60, 20), (0, 0)])
def test_middle_is_what_a_plain_version_makes(spark, percent, spm):
    r = random.Random(3)
    texts = [*ODD, *("".join(r.choice(["one ", "\n", "zwei", "\x01", "\x02", "e", "m", "é", "\t"]) for _ in range(r.randrange(60))) for _ in range(150)), "line of a long text\n" * 20_000, "z" * 300_000]
    ids = [*range(len(texts) - 2), None, None]
    df = rows_of(spark, texts, ids).repartition(3)
    got = middle.transform(df, percent=percent, spm_percent=spm).select("*", middle.restored().alias("back")).collect()
    assert Tally(tuple(x)[:6] for x in got) == Tally((i, *plain_middle(i, t, percent, spm)) for i, t in zip(ids, texts))
    assert sorted(x["back"] for x in got) == sorted(t or "" for t in texts)
    assert percent or {x["form"] for x in got} == {"plain"}
    assert percent < 100 or {x["form"] for x in got} == {"plain", "psm", "spm"}


def test_middle_repeats_ties_and_nothing(spark):
    df = rows_of(spark, ["a\nb\n", "a\nb\n", "a\nb\n"], [5, 5, 6])
    got = [tuple(x) for x in middle.transform(df).orderBy("doc_id").collect()]
    assert len(got) == 3 and got[0] == got[1] and got[2][0] == 6
    assert middle.transform(df.where("false")).count() == 0


def test_middle_stays_in_the_jvm(spark):
    plan = middle.transform(rows_of(spark, ["a"])).select(middle.restored())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# Resampling


def plain_resample(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    each = [found(t) for _, t in docs]
    s, t = Tally(b for _, f in each for b in f), Tally(b for x in target for b in found(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for (i, _), (n, f) in zip(docs, each):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    ready = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(ready[: len(ready) * percent // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def some_texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma9", "délta", "日本", "x", "ÀB", "it's", "--", "a_b", "10,5"]
    return ["".join(r.choice(vocabulary) + r.choice([" ", "\n", ", ", ""]) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("longest,buckets,percent,least", [(1, 10_000, 10, 20), (3, 97, 40, 1), (2, 10_000, 100, 0)])
def test_resample_is_what_a_plain_version_draws(spark, longest, buckets, percent, least):
    texts = [*ODD, *some_texts(1, 200), "Long wörd " * 150_000, "w" * 1_500_000]
    target = [*some_texts(2, 20), None]
    df = rows_of(spark, texts).repartition(5)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, percent=percent, least_words=least)
    assert sorted(map(tuple, got.collect())) == sorted(plain_resample(list(enumerate(texts)), target, longest, buckets, percent, least), key=lambda r: r[0])


def test_resample_ranks_repeats_and_null_ids(spark):
    text = "one two three " * 10
    ids = [3, 3, 3, None, None, 8]
    df = rows_of(spark, [text] * 6, ids)
    got = resample.resample(df, spark.createDataFrame([("two",)], "text string"), percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5, 6]
    want = plain_resample([(i, text) for i in ids], ["two"], percent=100)
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert [r[:4] for r in sorted(map(tuple, got), key=key)] == [r[:4] for r in sorted(want, key=key)]
    assert {r["doc_id"]: r["weight"] for r in got}[3] == {r[0]: r[2] for r in want}[3]


def test_resample_without_rows_or_target(spark):
    none = spark.createDataFrame([], "text string")
    df = rows_of(spark, ["word " * 30, ""])
    assert resample.resample(df.where("false"), none).count() == 0
    assert sorted(map(tuple, resample.resample(df, none, percent=50).collect())) == sorted(plain_resample([(0, "word " * 30), (1, "")], [], percent=50))


def test_a_row_of_the_matrix_is_one_text(spark):
    """Readers hold thousands of rows at once, so a row must not be a block of texts."""
    texts = ["two one two", None, "", "three " * 70_000, "one"]
    rows = resample.matrix(rows_of(spark, texts).coalesce(1), "doc_id", "text", buckets=50).orderBy("place").collect()
    assert [(r["i"], r["n_words"], sorted(r["counts"])) for r in rows] == [(0, 3, [1, 2]), (1, 0, []), (2, 0, []), (3, 70_000, [70_000]), (4, 1, [1])]
    assert len({(r["task"], r["place"]) for r in rows}) == 5


def test_rows_of_the_matrix_are_compressed():
    starts, cells, n = resample.compressed(3, np.array([2, 0, 2, 2]), np.array([5, 1, 5, 0]), 10)
    assert starts.tolist() == [0, 1, 1, 3] and cells.tolist() == [1, 0, 5] and n.tolist() == [1, 1, 2]


def test_words_are_not_cut_at_parts(monkeypatch):
    text = "Alpha beéta 12x gamma".encode()
    whole = resample.words(np.frombuffer(text, np.uint8), np.array([0, 9, len(text)]))
    monkeypatch.setattr(resample, "PART_BYTES", 3)
    part = resample.words(np.frombuffer(text, np.uint8), np.array([0, 9, len(text)]))
    spelt = lambda w: [(w[0][k], t) for k, t in zip(w[1].tolist(), w[2].tolist())]
    assert spelt(whole) == spelt(part)


# Token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FIFTY)


PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'re", "'ve", "'ll", "'s", "'", "r", "v", "!", "...", "1", "23", "é", "ß", "日本", " ", "<|endoftext|>", "<|endof", "|>", "😀", "\x1c", "\x85", "Hello", "ing", "́", "\r\n", "   ", "n't", "€", "\x00"]


def test_every_prefix_counts_as_the_library_counts_it(library):
    c, r = counts.Counter(FIFTY, P.PATTERN), random.Random(11)
    made = ["".join(r.choice(PIECES) for _ in range(r.randrange(24))) for _ in range(500)]
    made += ["".join(r.choice("aeinorst") for _ in range(r.randrange(80))) for _ in range(100)]
    for text in made:
        want = [len(e.ids) for e in library.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        assert c.counts(text).tolist() == want, text


def test_memos_are_bounded_and_change_nothing(monkeypatch, library):
    monkeypatch.setattr(counts, "MEMO_WORDS", 3)
    monkeypatch.setattr(counts, "MEMO_PAIRS", 3)
    c, r = counts.Counter(FIFTY, P.PATTERN), random.Random(2)
    for _ in range(100):
        text = " ".join(r.choice(PIECES) for _ in range(20))
        assert c.counts(text)[-1] == len(library.encode(text, add_special_tokens=False).ids)
    assert max(map(len, (c.pairs, c.later, c.others))) <= 3


def test_counts_of_odd_rows(spark, library):
    texts = [*ODD, "<|endoftext|>", "x <|endoftext|> y", "a" * 100_000, "long text, " * 100_000, "same", "same"]
    ids = [*range(len(texts) - 2), None, None]
    found = counts.count(rows_of(spark, texts, ids).repartition(3), FIFTY, P.PATTERN, limits=(0, 3, 512)).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert Tally((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found) == Tally((i, len((t or "").encode()), size(t)) for i, t in zip(ids, texts))
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for i, t in zip(ids, texts):
        if i is None or len(t or "") > 2000:
            continue
        sizes = [size((t or "")[:k]) for k in range(len(t or "") + 1)]
        for limit, held in zip((0, 3, 512), by_id[i]["fits"]):
            assert held == max(k for k, n in enumerate(sizes) if n <= limit)
    assert counts.count(rows_of(spark, ["a"]).where("false"), FIFTY, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        counts.count(rows_of(spark, ["a"]), FIFTY, P.PATTERN, limits=(-1,))


def test_questions_are_answered_from_steps(spark, library):
    texts = ["Whose budget holds this? Ours.", "日本 and 🙂", "", None]
    kept = counts.count(rows_of(spark, texts), FIFTY, P.PATTERN, steps=True).withColumn("a.b`c", F.lit(1))
    asked = kept.withColumn("n", F.when(F.col("doc_id") == 2, F.lit(None)).otherwise(F.lit(4)).cast("long"))
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    upto = {r["doc_id"]: r["tokens_upto"] for r in counts.upto(asked, "n").collect()}
    assert upto == {0: size(texts[0][:4]), 1: size(texts[1][:4]), 2: None, 3: 0}
    fit = {r["doc_id"]: r["chars_fitting"] for r in counts.fitting(asked, "n").collect()}
    for k in (0, 1):
        assert fit[k] == max(j for j in range(len(texts[k]) + 1) if size(texts[k][:j]) <= 4)
    assert {r["chars_fitting"] for r in counts.fitting(kept.withColumn("n", F.lit(-1)), "n").collect()} == {0}
