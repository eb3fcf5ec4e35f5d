import random

from weatherloom.llm import near_duplicates


def shingles(text):
    ws = (text or "").encode().translate(near_duplicates.LOWERED).split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def edited(rng, ws, changes):
    ws = list(ws)
    for _ in range(changes):
        at = rng.randrange(len(ws))
        kind = rng.random()
        if kind < 0.6:
            ws[at] = f"n{rng.randrange(10**6)}"
        elif kind < 0.8 and len(ws) > 8:
            del ws[at : at + rng.randrange(1, 6)]
        else:
            ws.insert(at, rng.choice(ws))
    return " ".join(ws)


def test_components_equal_brute_force(make_docs):
    rng = random.Random(12)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        size = 120 if g == 0 else 12
        for _ in range(size):
            rows.append((len(rows), edited(rng, base, rng.randrange(0, 1 + len(base) // 18))))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE\tTwo"), (2005, "one two three"), (2005, "one two three")]
    rows += [(2006, "long " * 40_000 + "x"), (2007, "long " * 40_000 + "y"), (None, passage), (-5, rows[0][1].upper())]
    rng.shuffle(rows)
    found = near_duplicates.near_duplicates(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_chain_is_one_component(make_docs):
    rows, ws = [], [f"c{i}" for i in range(60)]
    for i in range(40):
        rows.append((i, " ".join(ws)))
        ws = [*ws[2:], f"c{100 + 2 * i}", f"c{101 + 2 * i}"]
    assert {r.component_id for r in near_duplicates.near_duplicates(make_docs(rows)).collect()} == {0}


def test_one_of_each_keeps_columns(make_docs):
    docs = make_docs([(2, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (3, None), (4, "")])
    out = near_duplicates.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_shuffle_way_and_empty_table(make_docs):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f g h"), (4, "other words here")]
    found = near_duplicates.near_duplicates(make_docs(rows), most_broadcast=0).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)
    assert near_duplicates.near_duplicates(make_docs([])).count() == 0


def test_one_of_each_with_null_and_repeated_ids(make_docs):
    def words(name, tail=""):
        return " ".join(f"{name}{i}" for i in range(40)) + tail

    rows = [(None, words("a")), (None, words("a", " x")), (None, words("a", " y")), (None, words("alone"))]
    rows += [(7, words("p")), (None, words("p", " x")), (None, words("p", " y"))]
    rows += [(3, words("q")), (9, words("q", " x")), (9, words("r")), (12, words("s")), (12, words("s", " x"))]
    rows += [(9, None), (None, ""), (None, ""), (None, words("alone"))]
    out = [(r.doc_id, (r.text or "").split(" ")[0]) for r in near_duplicates.one_of_each(make_docs(rows)).collect()]
    assert sorted(out, key=str) == sorted([(None, "a0"), (None, "alone0"), (7, "p0"), (3, "q0"), (9, "r0"), (12, "s0"), (9, ""), (None, "")], key=str)


def changed_copies(n, words=60, seed=4):
    """One text, one word of each copy changed: star links cannot join them all, most pairs lie just below the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    return [(i, " ".join([*base[: (at := rng.randrange(words))], f"n{i}", *base[at + 1 :]])) for i in range(n)]


def test_small_blocks_give_the_same_components(make_docs, monkeypatch):
    rows = changed_copies(90)
    for size, weight in ((4, 1 << 24), (1024, 2000)):
        monkeypatch.setattr(near_duplicates, "BLOCK", size)
        monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", weight)
        found = near_duplicates.near_duplicates(make_docs(rows)).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)


def test_rows_of_the_cross_search_grow_with_the_group(make_docs, monkeypatch):
    """Every table that is written, on 100, 200 and 400 copies: none grows with the square."""
    seen = {}

    def counted(df, name, rows=None, write=near_duplicates.stored):
        out = write(df, name, rows)
        seen[name, size] = max(out.count(), seen.get((name, size), 0))
        return out

    monkeypatch.setattr(near_duplicates, "stored", counted)
    for size in (100, 200, 400):
        assert len({r.component_id for r in near_duplicates.near_duplicates(make_docs(changed_copies(size))).collect()}) < size
    for name in {n for n, _ in seen}:
        assert seen[name, 400] <= 2.6 * max(seen[name, 200], 40), name
    assert seen["near-links", 400] < 4 * 400


def test_one_of_each_keeps_columns_with_the_names_used_inside(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "a", "b", "c", "d", "e"), (2, text, "f", "g", "h", "i", "j"), (3, "other words that stand alone here", "k", "l", "m", "n", "o")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "_h", "_id", "_of", "_row", "_d"])
    got = near_duplicates.one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
