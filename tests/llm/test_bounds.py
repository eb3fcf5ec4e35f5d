"""Bounds that hold for any table: rows that reach the driver, work on many matches."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from weatherloom.llm import decontamination, language, personal, ranking


def collected(monkeypatch):
    """Rows of every frame that goes to pandas."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, to_pandas = [], DataFrame.toPandas

    def counted(self):
        out = to_pandas(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "toPandas", counted)
    return seen


def test_one_id_with_very_many_rows_stays_within_the_bounds(spark, make_docs, monkeypatch):
    seen = collected(monkeypatch)
    hot_id = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(i).encode()) % 5 != 4)
    hot = spark.range(50_000).select(F.lit(hot_id).cast("long").alias("doc_id"), F.concat(F.lit("these are words number "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    rest = spark.range(400).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("ein satz mit der nummer "), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    docs = hot.union(rest).union(hot.limit(1).crossJoin(spark.range(3000).select()))
    model = language.train(docs, most=300, least=50)
    assert model.languages == ["de", "en"] and seen[-1] <= 8 * (300 + 50 * 2)
    labels = docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    ranking.train(docs, labels, 0.3, held=4, most=100, least=20)
    assert seen[-1] <= 2 * (100 + 2 * 20)


def test_rare_languages_are_learned_at_any_size(spark, make_docs):
    common = spark.range(20_000).select("id", F.concat(F.lit("the usual text with words "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(12).select((F.col("id") + 90_000).alias("id"), F.lit("ξένα λόγια για όλους εδώ").alias("text"), F.lit("el").alias("lang"))
    model = language.train(common.union(rare).withColumnRenamed("id", "doc_id"), most=200, least=30)
    assert model.languages == ["el", "en"] and model.predict("λόγια για όλους")[0] == "el"


def test_language_forward_pass_equals_plain_sums(spark, make_docs):
    """Mean of the embeddings of all n-grams, softmax of its product, by hand."""
    import math

    docs = [(i, f"wort satz der die {i}", "de") if i % 2 else (i, f"the word of this {i}", "en") for i in range(90)]
    model = language.train(make_docs(docs))
    for text in ("the word", "Der Satz, die Wörter!", "x"):
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        # pairs with a letter and triples around one: other characters are the edges of words
        grams = [c for c in low if c != " "] + [p for p in zip(low, low[1:]) if p != (" ", " ")] + [t for t in zip(low, low[1:], low[2:]) if t[1] != " "]
        assert language.subwords(text, len(model.table)).sum() == len(grams)
        rows = sum(language.subwords(text, len(model.table))[b] * model.table[b] for b in range(len(model.table)))
        z = [(rows[k] / len(grams) + model.bias[k]) / model.temperature for k in range(2)]
        p = [math.exp(v) / sum(math.exp(w) for w in z) for v in z]
        name, score, _ = model.predict(text)
        assert score == pytest.approx(max(p)) and name == model.languages[p.index(max(p))]


def test_pairwise_loss_and_threshold_equal_plain_python():
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 4))
    y = (x[:, 0] + 0.3 * rng.normal(0, 1, 60) > 0.4).astype(int)
    model = ranking.fit(x, y, 0.3)
    strength = [sum(w * max(-8, min(8, (v - m) / s)) for w, v, m, s in zip(model.weights, row, model.mean, model.scale)) for row in x]
    assert model.strengths(x) == pytest.approx(strength)
    below = sum(s < model.threshold for s in strength)
    assert below == pytest.approx((y == 0).sum(), abs=1)
    scores = [1 / (1 + math.exp(-(model.slope * (s - model.threshold) + math.log(0.3 / 0.7)))) for s in strength]
    assert model.scores(x) == pytest.approx(scores)

    def loss(w):
        z = np.clip((x - model.mean) / model.scale, -8, 8) @ w
        return np.mean(np.log1p(np.exp(-(z[y == 1][:, None] - z[y == 0][None, :])))) + 5e-4 * w @ w

    # the fit stands near the minimum of the loss over all pairs: small steps in any direction gain little
    assert loss(model.weights) < loss(np.zeros(4)) - 0.2
    assert all(loss(model.weights) <= loss(model.weights + step) + 2e-3 for i in range(4) for step in (0.1 * np.eye(4)[i], -0.1 * np.eye(4)[i]))


def test_many_matches_in_one_text_are_cheap(spark, make_docs):
    numbers = ", ".join(str(10 + i % 90) for i in range(200_000))
    mails = " ".join(f"a{i}@b.com" for i in range(4_000))
    start = time.perf_counter()
    got = {r.doc_id: r for r in personal.digest(personal.find(make_docs([(1, numbers), (2, mails), (3, mails), (3, mails)]))).collect()}
    assert time.perf_counter() - start < 60
    assert got[1].spans == "" and got[2].n_email == 4_000 and got[3].spans == got[2].spans
    at, want = 0, []
    for i in range(4_000):
        want.append(f"email:{at}:{at + len(f'a{i}@b.com')}")
        at += len(f"a{i}@b.com") + 1
    assert got[2].spans == ",".join(want)


@pytest.mark.parametrize("block", [1, 2, 256])
def test_places_do_not_depend_on_the_blocks(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(personal, "BLOCK", block)
    text = "x@y.org, é q@r.de 1.2.3.4 +49 123 4567 and 4111 1111 1111 1111 " * 3
    row = personal.digest(personal.find(make_docs([(1, text), (2, None), (3, "none")]))).filter("doc_id = 1").first()
    assert row.n_email == 6 and row.n_ip == 3 and row.n_card == 3 and row.n_phone == 3
    for span in row.spans.split(","):
        kind, a, b = span.split(":")
        assert text[int(a) : int(b)] in ("x@y.org", "q@r.de", "1.2.3.4", "+49 123 4567", "4111 1111 1111 1111"), span


def test_no_text_travels_with_the_words_when_terms_are_many(spark, make_docs):
    keyed = decontamination.doc_key(make_docs([(1, "a b c"), (1, "a b c"), (None, "c d")]), "text", "doc_id")
    terms = spark.createDataFrame([("a",), ("c",)], "term string")
    few, many = (decontamination.postings(keyed, terms, 10, f) for f in (True, False))
    assert {tuple(map(str, r)) for r in few.collect()} == {tuple(map(str, r)) for r in many.select(few.columns).collect()}
    plan = decontamination.placed(keyed, terms)._jdf.queryExecution().optimizedPlan().toString()
    exploded = plan[plan.index("Generate posexplode") :]
    assert "all" not in exploded
