"""The pipeline's removal of repeats leaves lines and spaces as they are, and clean texts whole."""

import numpy as np

import corpus_pipeline
from fluvion.llm import substring


def test_cuts_by_spans():
    text = "  é one\n\ntwo\tthree  four \n".encode()
    cut = lambda *drop: substring.without(text, np.array(drop, bool)).decode()
    assert cut(0, 0, 0, 0, 0) == text.decode()
    assert cut(0, 1, 0, 0, 0) == "  é two\tthree  four \n"
    assert cut(1, 0, 0, 1, 1) == "  one\n\ntwo\t \n"
    assert cut(1, 1, 1, 1, 1) == "   \n"


def test_clean_documents_keep_their_text(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, "a line\n\tindented  twice\r\nend \n"), (2, f"first\n{passage}\nlast"), (3, f"other\n\n{passage}\n  tail\n"), (4, passage)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    want = {1: rows[0][1], 2: rows[1][1], 3: "other\n\ntail"}
    assert got == {i: (t, len(t)) for i, t in want.items()}
