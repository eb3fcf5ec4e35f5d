import collections
import hashlib
import random
import re

from pyspark.sql import functions as F
from weatherloom.llm import decontamination


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def near_items(docs, items):
    """Items with a proximity match, for each document."""
    counts = collections.Counter(w for _, t in docs for w in words(t))
    spots = collections.defaultdict(set)
    for i, t in items:
        ws = words(t)
        for k in range(max(len(ws) - 9, 1) if ws else 0):
            rare = min(ws[k : k + 10], key=lambda w: (counts[w], w.encode()))
            for p in range(k, min(k + 10, len(ws))):
                if ws[p] == rare:
                    spots[rare].add(("" if i is None else str(i), frozenset(ws[max(0, p - 9) : p] + ws[p + 1 : p + 10])))
    out = []
    for _, t in docs:
        ws, found = words(t), set()
        for p, w in enumerate(ws):
            near = set(ws[max(0, p - 9) : p] + ws[p + 1 : p + 10])
            found |= {item for item, around in spots.get(w, ()) if not around or len(around & near) / len(around) >= 0.8}
        out.append(len(found))
    return out


def brute(docs, items):
    near = near_items(docs, items)
    wins = {}
    for i, t in items:
        ws = words(t)
        for k in range(len(ws) - min(10, len(ws)) + 1 if ws else 0):
            wins.setdefault(tuple(ws[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for (d, t), n_near in zip(docs, near):
        ws, hit, ids = words(t), set(), set()
        for wide in {len(w) for w in wins}:
            for k in range(len(ws) - wide + 1):
                found = wins.get(tuple(ws[k : k + wide]))
                if found:
                    hit |= set(range(k, k + wide))
                    ids |= found
        out.append((d, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit), n_near))
    return sorted(out, key=str)


def make(rng, n):
    return "".join(rng.choice(["a", "b", "C", "é", "É", "d1"]) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))


def test_equals_brute_force(spark, make_docs):
    rng = random.Random(6)
    items = [(i, make(rng, rng.randrange(1, 16))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (None, "z z z"), (7, items7 := "q r s t"), (7, items7)]
    docs = [(i, make(rng, rng.randrange(0, 120))) for i in range(120)]
    docs += [(200 + i, make(rng, 5) + items[i][1] + " " + make(rng, 4)) for i in range(25)]
    docs += [(300, None), (301, ""), (302, "Z z z z"), (303, "a " * 30_000), (304, "q r s t"), (304, "q r s t"), (304, "other"), (None, "z z z")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    got = decontamination.decontaminate(make_docs(docs), bench).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    kept = decontamination.clean(make_docs(docs), bench)
    assert kept.columns == make_docs(docs).columns
    assert kept.count() == sum(not r[5] for r in brute(docs, items))


def test_the_shuffle_way_gives_the_same(spark, make_docs):
    docs = [(1, "one two three four five six seven eight nine ten eleven"), (2, "nothing here")]
    bench = spark.createDataFrame([(1, docs[0][1])], "item_id long, text string")
    got = decontamination.decontaminate(make_docs(docs), bench, most_broadcast=0).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, [(1, docs[0][1])])


def test_proximity(spark, make_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = make_docs([(1, "epsilon and delta gamma beta then alpha"), (2, "alpha only")])
    _, index, tests, hint = decontamination.build(docs, bench)
    assert {r.doc_id for r in decontamination.proximity_matches(index, tests, hint, 0.9).collect()} == {1}
    got = decontamination.decontaminate(docs, bench).select("doc_id", "contaminated", "n_near").collect()
    assert sorted(map(tuple, got)) == [(1, False, 1), (2, False, 0)]


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(make_docs([(1, "a b")]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
    assert got[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontamination.decontaminate(make_docs([]), none).filter(F.lit(True)).count() == 0
