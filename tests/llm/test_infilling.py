"""Cuts at any character of any text, and the forms against plain Python strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherloom.llm import infilling

TEXTS = ["", "a", "é", "日本語のテキスト", "plain ascii " * 400, "mixed é日𝄞 " * 300, "a" * 500 + "日" * 500 + "b" * 500 + "𝄞" * 100, "\n\t\r x"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("error", [0, 3, 100])
@pytest.mark.parametrize("step", [7, 1 << 20])
def test_every_rank_is_exact(monkeypatch, text, error, step):
    monkeypatch.setattr(infilling, "STEP", step)
    index = infilling.RankIndex(text.encode(), error)
    assert index.n == len(text)
    at = np.cumsum([0] + [len(c.encode()) for c in text]).tolist()
    assert [index.offset(r) for r in range(len(text) + 1)] == at
    assert max(abs(index.predict(r) - at[r]) for r in range(len(text) + 1)) <= error
    assert np.abs(index.differences).max() <= error


def test_single_bytes_need_one_segment_and_more_error_fewer():
    assert len(infilling.RankIndex(b"x" * 100_000).ranks) == 2  # the text and its end
    rng = random.Random(1)
    data = "".join(rng.choice("aé日") for _ in range(5000)).encode()
    sizes = [len(infilling.RankIndex(data, e).ranks) for e in (0, 5, 50)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[2]


def brute(doc_id, text, rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < spm:
        return (doc_id, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b])
    return (doc_id, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b])


def test_forms_equal_plain_python_and_restore(spark, make_docs):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(200)] + [(7, None), (None, "no id"), (None, None), (9, "has <P> inside"), (10, "has <S><M>"), (11, "<" * 50), (11, "<P" * 50 + "<S" * 20 + "<M" * 9)]
    rows += [(12, "twice")] * 3 + [(13, "日é" * 300_000)]
    out = infilling.transform(make_docs(rows).repartition(3))
    got = out.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.back) for r in got), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates(spark, make_docs):
    docs = make_docs([(i, "some text") for i in range(50)])
    assert {r.form for r in infilling.transform(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in infilling.transform(docs, rate=100, spm=100).collect()} == {"spm"}


def test_empty_table(spark, make_docs):
    assert infilling.transform(make_docs([])).count() == 0
