import random
import re

import pytest
from weatherloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values()) * share
    while True:
        free = [s for s in names if s not in full]
        rest = left - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def corpus(rng):
    rows = []
    for i in range(900):
        source = rng.choice(["big"] * 6 + ["B", "a", "é", "\U0001f600", "￿", None, "tiny"])
        n = rng.randrange(0, 80) if source != "tiny" else 1
        rows.append((i, " x " * n if rng.random() < 0.3 else "word\t" * n, "en", source))
    return rows + [(1000, None, "en", "a"), (1001, "", "en", "none"), (1002, "w " * 30_000, "en", "big"), (5, "w w w", "en", "B"), (5, "w w w", "en", "B")]


def test_targets_and_taken_words(make_docs):
    rows = corpus(random.Random(8))
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    found = mixing.mix(make_docs(rows), block_words=16, rows_per_cell=50, least_chunk=64).collect()
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 0.02 * want[source] + 8


def test_reruns_agree(make_docs):
    docs = make_docs(corpus(random.Random(9)))
    a, b = (sorted((r.doc_id, r.taken) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_documents_are_repeated_as_the_mix_takes_them(make_docs):
    rows = [(i, "w " * 40, "en", "ab"[i % 2]) for i in range(200)] + [(500, None, "en", "a")]
    out = mixing.mixed(make_docs(rows)).collect()
    counts = {}
    for r in out:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 2 and 500 not in counts and 270 <= len(out) <= 330 and out[0].score == "x"


def test_rows_with_null_or_repeated_ids_have_their_own_counts(make_docs):
    rows = [((None, 7, i)[i % 3], "w " * (20 + i), "en", "abb"[i % 2]) for i in range(240)]
    docs = make_docs(rows)
    want = {r["size"]: round(r.taken / r["size"]) for r in mixing.mix(docs, block_words=64).collect()}
    assert len(set(want.values())) > 1
    got = [len(r.text.split()) for r in mixing.mixed(docs, block_words=64).collect()]
    assert {n: got.count(n) for n in want} == want


def test_repeated_rows_are_taken_in_part(make_docs):
    docs = make_docs([(1, "w " * 40, "en", "a")] * 400 + [(i, "w " * 40, "en", "b") for i in range(1000, 1200)])
    words = sum(r.taken for r in mixing.mix(docs).collect() if r.source == "a")
    assert abs(mixing.mixed(docs).filter("source = 'a'").count() - words / 40) <= 40


def test_a_row_repeated_very_often_is_cut_by_its_count(make_docs):
    rows = [(7, "w w w", "en", "a")] * 700 + [(None, "x y", "en", "a")] * 300 + [(i, "w " * (i % 9), "en", "ab"[i % 2]) for i in range(500)]
    want, got = ([tuple(r) for r in mixing.mix(make_docs(rows), block_words=16, rows_per_cell=n).collect()] for n in (10_000, 20))
    assert sorted(want, key=str) == sorted(got, key=str) and len(got) == 1500


def test_columns_with_the_names_used_inside(spark):
    names = ["_h", "_id", "_of", "_source", "_mean", "_rows", "_copy", "_row", "_d", "_s", "h", "size", "start", "cell"]
    docs = spark.createDataFrame([(i, "w " * 40, "ab"[i % 2], *["keep"] * len(names)) for i in range(60)], ["doc_id", "text", "source", *names])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {("keep",) * len(names)}


def test_empty_table_and_no_words(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(make_docs([(1, None, "en", "a"), (2, " ", "en", "b")])).collect()] == [(0.0, 0)] * 2
