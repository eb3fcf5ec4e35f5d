"""Language, quality ranking and voting rules: held-out accuracy, brute force for counts, and edge cases."""

import re
import zlib

import numpy as np
import pytest
from weatherloom.llm import language, ranking, votes
from weatherloom.llm.shared import table


def test_language_on_held_out_documents(spark, sf_dir, make_docs):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    rows = language.identify(docs, model).select("doc_id", "lang", "lang_pred", "score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    odd = language.identify(make_docs([(1, None), (2, ""), (3, "12 34 !?"), (4, "the " * 400_000), (None, "the")]), model).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[3].lang_pred == "en" and odd[4].lang_pred in model.languages


def test_language_without_labels(make_docs):
    docs = make_docs([(1, "text", None)])
    assert language.identify(docs, language.train(docs)).first().lang_pred == "und"
    assert language.identify(make_docs([]), language.train(make_docs([]))).count() == 0


def test_subwords_do_not_depend_on_the_step():
    text = "Ünïcode wörds, and more " * 200
    whole = language.subwords(text, 1 << 10)
    step = language.STEP
    try:
        language.STEP = 7
        assert (language.subwords(text, 1 << 10) == whole).all()
    finally:
        language.STEP = step


def test_training_takes_no_held_out_row(make_docs):
    rows = [(i, "aaa bbb" if zlib.crc32(str(i).encode()) % 3 != 1 else "ccc ddd", "xx" if zlib.crc32(str(i).encode()) % 3 != 1 else "yy") for i in range(90)]
    assert language.train(make_docs(rows)).languages == ["xx"]


def test_ranking_on_held_out_labels(spark, sf_dir, make_docs):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ranking.train(docs, labels, cut=0.3)
    rows = ranking.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and np.mean([r.predicted == r.quality for r in held]) > 0.95
    odd = ranking.score(make_docs([(1, None), (2, ""), (3, "w " * 500_000)]), model).collect()
    assert odd[0].score == odd[1].score and all(0 <= r.score <= 1 for r in odd)
    assert "score" in ranking.accepted(make_docs([(1, "a b c")]), None).columns


def test_ranking_without_both_labels(spark, make_docs):
    docs = make_docs([(1, "a"), (2, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = ranking.train(docs, labels, cut=0.3)
    assert model is None and {r.predicted for r in ranking.score(docs, model).collect()} == {1}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text):
    ws = words(text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))


def test_base_counts_equal_brute_force(spark, make_docs, sf_dir):
    import random

    rng = random.Random(4)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "a b c d e f", "x\n x\nx\n\nx", "é b c \x1c d\x85e", "# * | <>\x0b&%$", "a a a a a a a"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d", "é ", "#", "\r", "日 "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [r.text for r in table(spark, sf_dir, "documents").limit(40).collect()]
    got = {r.doc_id: tuple(r[c] for c in votes.BASE) for r in votes.with_measures(make_docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_votes_keep_good_and_drop_bad_documents(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = votes.judge(votes.with_measures(docs)).join(labels, "doc_id").select("base_failed", "kept", "quality").collect()
    rest = [r for r in judged if not r.base_failed]
    assert np.mean([r.kept for r in rest if r.quality == 1]) > 0.95
    assert np.mean([r.kept for r in judged if r.quality == 0]) < 0.2
    assert not any(r.kept for r in judged if r.base_failed)


def test_votes_on_empty_table(make_docs):
    assert votes.judge(votes.with_measures(make_docs([]))).count() == 0


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    chances = {1: (0.7, 0.05, 0.25), 0: (0.2, 0.6, 0.2)}
    cast = np.stack([[rng.choice([1, 0, -1], p=chances[int(g)]) for g in good] for _ in range(5)], 1)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    w = votes.expectation_maximisation(patterns, counts.astype(float))
    assert abs(w.prior - 0.8) < 0.03 and np.abs(w.on_good - chances[1]).max() < 0.05 and np.abs(w.on_bad - chances[0]).max() < 0.06


def test_ranking_learns_from_every_labelled_row_outside_the_fold(spark, make_docs):
    docs = [(i, " ".join(["good"] * (i % 7) + [f"w{i * k % 50}" for k in range(i % 31 + 1)]) + "!" * (i % 3), "en") for i in range(1200)]
    quality = {i: int(i % 31 + 9 * (i % 3) + i * 17 % 13 > 30) for i in range(1200)}
    labels = spark.createDataFrame([*quality.items()], "doc_id long, quality int")
    model = ranking.train(make_docs(docs + docs[:400]), labels, 0.3, most=60, least=5)
    learned = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5]
    x, y = np.array([ranking.features(d[1]) for d in learned]), np.array([quality[d[0]] for d in learned])
    assert model.mean == pytest.approx(x.mean(0), abs=1e-6)
    assert model.threshold == pytest.approx(np.quantile(model.strengths(x), (y == 0).mean(), method="midpoint"), abs=1e-9)
    local = ranking.fit(x, y, 0.3, most=60)
    assert model.scores(x) == pytest.approx(local.scores(x), abs=1e-3)

    def loss(w):
        z = np.clip((x - model.mean) / model.scale, -8, 8) @ w
        return np.mean(np.logaddexp(0, -(z[y == 1][:, None] - z[y == 0][None, :]))) + 5e-4 * w @ w

    steps = 0.05 * np.vstack([np.eye(x.shape[1]), -np.eye(x.shape[1])])
    assert all(loss(model.weights) <= loss(model.weights + s) + 1e-4 for s in steps)  # the loss of all pairs
