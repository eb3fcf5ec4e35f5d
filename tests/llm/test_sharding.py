import hashlib
import random
import zlib

from weatherloom.llm import sharding


def key(text):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)


def brute(rows, shards, share=0.01):
    recs = sorted(((key(t), key(str(i) if i is not None else None), -1 if i is None else i, len((t or "").encode()) + 1, t) for i, t in rows), key=lambda r: r[:4])
    total, at, placed, groups = sum(r[3] for r in recs), 0, [], {}
    for r in recs:
        lo, hi = groups.get(r[0], (at, at))
        groups[r[0]] = (lo, at + r[3])
        placed.append((at, r))
        at += r[3]
    ends = []
    for j in range(1, shards):
        w = total * j // shards
        lo, hi = next(g for g in groups.values() if g[0] <= w < g[1])
        ends.append((lo if w - lo <= hi - w else hi) if hi - lo <= share * total / shards else w)
    out, slots = [], {}
    for start, r in placed:
        s = sum(start >= e for e in ends)
        out.append((None if r[2] == -1 else r[2], r[3], zlib.crc32((r[4] or "").encode()), s, slots.setdefault(s, 0)))
        slots[s] += 1
    return out


def test_equals_a_sorted_pass_over_all_records(make_docs):
    rng = random.Random(3)
    texts = ["hot group " * 40] * 400 + ["é" * rng.randrange(60) for _ in range(300)] + [None, "", "", "x" * 50_000]
    texts += ["".join(rng.choice("abc ") for _ in range(rng.randrange(300))) for _ in range(500)]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = sharding.shard_by_size(make_docs(rows), rows_per_range=50, samples_per_range=8, least_ranges=4)
    got = sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in found.collect())
    assert got == sorted(brute(rows, 8))
    assert {r.law for r in found.collect()} == {"bytes"} and found.filter("grown_shard is not null").count() == 0


def test_repeated_rows_null_ids_and_few_rows(make_docs):
    rows = [(1, "same text"), (1, "same text"), (None, "a"), (2, None)]
    got = sharding.shard_by_size(make_docs(rows)).collect()
    assert len(got) == 4
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_a_row_repeated_very_often_is_cut_by_its_count(make_docs):
    rows = [(7, "same row")] * 900 + [(None, None)] * 300 + [(i, "x" * (i % 50)) for i in range(400)]
    found = sharding.shard_by_size(make_docs(rows), rows_per_range=20, samples_per_range=8, least_ranges=4).collect()
    got = sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in found), key=str)
    assert got == sorted(brute(sorted(rows, key=str), 8), key=str)


def test_empty_table(make_docs):
    assert sharding.shard_by_size(make_docs([])).count() == 0
