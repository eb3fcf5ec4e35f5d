"""The class model against plain Python: counts, base score, exchange, probabilities."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weatherloom.llm import classes
from weatherloom.llm.catalog import op13_language_model

FRUIT, VERB, PLACE = [[f"{w}{i}" for i in range(12)] for w in ("fruit", "verb", "place")]


def planted(n, seed=5):
    """Texts whose words follow a cycle of three classes; within a class words are drawn freely."""
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(kind) for _ in range(6) for kind in (FRUIT, VERB, PLACE))) for i in range(n)]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


CASES = [(1000, None), (1001, ""), (1002, "  \n\t "), (1003, "FRUIT1 Verb2 neverseen x"), (None, "fruit1 verb1"), (1004, "é é \x1cx É"), (1004, "é é \x1cx É"), (1005, "w" * 5000 + " fruit1"), (1005, "other text of the id")]


@pytest.fixture(scope="module")
def model(spark, make_docs):
    return classes.train(make_docs(planted(300)), k=3, rounds=20, buckets=16)


def test_counts_and_base_equal_plain_python(spark, make_docs, tmp_path):
    rows = planted(200) + CASES
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_language_model(spark, str(tmp_path)).collect()
    part = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows if i is not None}
    learned = [t for i, t in rows if i is not None and part[i] != 1]
    counts = Counter(w for t in learned for w in [*tokens(t), ""])
    total, distinct = sum(counts.values()), len(counts)

    def wanted(i, text):
        own = [*tokens(text), ""]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        return (i, part.get(i) == 1, len(own), sum(counts[w] > 0 for w in own), total, round(base, 6))

    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted((wanted(*r) for r in rows), key=repr)
    assert all(math.isfinite(r.score) and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)


@pytest.mark.parametrize("most_bytes", [1 << 22, 2000, 1])
@pytest.mark.parametrize("step", [50, 1 << 24])
def test_score_equals_a_walk_over_the_words(spark, make_docs, monkeypatch, most_bytes, step):
    """Whether words are looked up in tasks or joined."""
    rows = planted(60) + CASES
    m = classes.train(make_docs(rows), k=4, rounds=4, share=64, buckets=8, most_bytes=most_bytes)
    monkeypatch.setattr(classes, "STEP", step)
    counts = {r.w: r.n for r in m.words.collect()}

    def wanted(text):
        last, total = m.classes[m.units.end], 0.0
        for w in tokens(text):
            c = m.classes[m.units.of(pa.array([w]))[0]]
            total += m.moves[last, c] + (math.log10(counts[w]) + m.known[c] if w in counts else m.unknown[c])
            last = c
        return total + m.moves[last, m.classes[m.units.end]]

    got = classes.score(make_docs(rows).repartition(2), m).collect()
    assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=repr) == sorted(((i, round(wanted(t), 6)) for i, t in rows), key=repr)
    assert (len(m.near) == 0) == (most_bytes == 1)


def test_probabilities_add_up_in_every_context(model):
    counts = {r.w: r.n for r in model.words.collect() if r.w}
    by_class = np.zeros(4)
    for w, n in counts.items():
        c = model.classes[model.units.of(pa.array([w]))[0]]
        by_class[c] += 10 ** (math.log10(n) + model.known[c])
    by_class[:3] += 10 ** model.unknown[:3]
    by_class[3] = 1  # the end
    assert np.allclose((10**model.moves) @ by_class, 1)


def test_exchange_finds_planted_classes_and_never_gets_worse(model):
    of = {w: int(model.classes[model.units.of(pa.array([w]))[0]]) for w in FRUIT + VERB + PLACE}
    groups = [{of[w] for w in kind} for kind in (FRUIT, VERB, PLACE)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert model.history == sorted(model.history) and len(model.history) > 2


def test_gains_equal_differences_of_likelihood():
    rng = np.random.default_rng(3)
    n, k = 9, 3
    pairs = rng.integers(0, 20, (n + 1, n + 1)).astype(float)
    own = np.append(np.arange(n) % k, k)

    def table(of):
        out = np.zeros((k + 1, k + 1))
        np.add.at(out, (of[:, None].repeat(n + 1, 1), of[None, :].repeat(n + 1, 0)), pairs)
        return out

    for unit in range(n):
        after, before = (np.bincount(own, x, k + 1) for x in (pairs[unit], pairs[:, unit]))
        got = classes.gains(table(own), own[unit], after, before, pairs[unit, unit])
        want = []
        for c in range(k):
            moved = own.copy()
            moved[unit] = c
            want.append(classes.likelihood(table(moved)))
        assert np.allclose(got[:k] - got[0], np.array(want) - want[0])


def test_held_out_texts_are_likelier_than_by_single_words(spark, make_docs, model):
    got = classes.score(make_docs(planted(50, seed=9)), model).collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got) and all(r.score > r.base_score for r in got)


def test_transitions_are_those_of_the_texts(spark, make_docs):
    rows = planted(5) + CASES
    units = classes.Units(pa.array(FRUIT), 5)
    n = units.end + 1
    want = np.zeros((n, n), int)
    for _, t in rows:
        line = [units.end, *(units.of(pa.array([w]))[0] for w in tokens(t)), units.end]
        for a, b in zip(line, line[1:]):
            want[a, b] += 1
    table = classes.profiles(classes.transition_counts(make_docs(rows).select("text").repartition(3), units), n).collect()
    after, before = np.zeros((n, n), int), np.zeros((n, n), int)
    for r in table:
        after[r.unit], before[:, r.unit] = r.after, r.before
    assert (after == want).all() and (before == want).all()


def test_nothing_to_learn_from_and_empty_table(spark, make_docs):
    nothing = classes.train(make_docs([]), k=2, rounds=2, buckets=4)
    got = classes.score(make_docs([(1, "a b"), (2, None)]), nothing).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in got)
    assert classes.score(make_docs([]), nothing).count() == 0
