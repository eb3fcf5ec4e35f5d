"""Benchmark decontamination with a positional inverted index.

Every window of ``width`` words of a test item is searched through its rarest word, by corpus frequency. The index stores
the postings of those words: document, position, and the ``width - 1`` words on either side. The lists of the window's
other words are intersected at their offsets through these neighbours, which gives the longest common run around the
posting. Runs of a whole window are phrase matches. Proximity matches are postings near which at least ``NEAR`` of the
distinct words around the item's word stand, in any order; they are counted and never decide ``contaminated``.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. An item of fewer than ``width`` words, but not
none, is one window. Null and empty texts have no words. Repeated documents each get the result; repeated items count
once per id; a null item id is listed as an empty string. Empty tables give no rows or no hits. Whole texts are indexed.
Extra columns are ignored.

Everything here is DataFrame functions. Broadcast tables hold at most ``most_broadcast`` words of the test items; beyond
that Spark joins by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weatherloom.llm.shared import LOWER, UPPER, stored

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least share of the words around an item's word that a proximity match needs.
NEAR = 0.8
#: Between words, before lower-casing.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(word: Column) -> Column:
    """Lower-cases A-Z only. Most words have no capital at all, which the cheap ``lower`` tells."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """The words, not yet lower-cased; an empty first or last entry may stay and matches nothing."""
    return F.split(text, GAP)


def doc_key(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Id, a hash that tells documents with the same id apart, and the text."""
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))


def item_words(items: DataFrame, text: str, key: str) -> DataFrame:
    words = F.filter(F.split(F.translate(F.col(text), UPPER, LOWER), GAP), lambda w: w != "")
    out = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words.alias("words"))
    return out.filter(F.size("words") > 0).distinct()


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def frequencies(keyed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each test word occurs in all documents; counts are combined before the shuffle."""
    words = keyed.select(F.explode(split_words(F.col("text"))).alias("w")).select(ascii_lower(F.col("w")).alias("term"))
    return words.join(vocabulary, "term").groupBy("term").count()


def rarest(items: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """Test postings ``(term, item, left, right, need)``: places of each window's rarest word, with the item's words before
    it (nearest first) and after it, and the length of a window of that item."""
    counted = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))))
    places = counted.select("item", "words", "at", F.posexplode(F.slice("words", F.col("at"), width)).alias("off", "term"))
    ranked = places.join(counts, "term", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    first = ranked.groupBy("item", "words", "at").agg(F.min_by("term", F.struct("n", "term")).alias("rare"))
    own = first.select("item", "words", "at", "rare", F.posexplode(F.slice("words", F.col("at"), width)).alias("off", "term"))
    at = F.col("at") + F.col("off")
    return (
        own.filter(F.col("term") == F.col("rare"))
        .select("term", "item", "words", at.alias("at"))
        .distinct()
        .select(
            "term",
            "item",
            F.reverse(F.slice("words", F.greatest(F.col("at") - (width - 1), F.lit(1)), F.least(F.col("at") - 1, F.lit(width - 1)))).alias("left"),
            F.slice("words", F.col("at") + 1, width - 1).alias("right"),
            F.least(F.size("words"), F.lit(width)).alias("need"),
        )
    )


def placed(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, h, all, pos, term)`` where the terms are too many to broadcast: only words and places are shuffled, and
    the places of a document go back to its text in one list."""
    words = keyed.select("doc_id", "h", F.posexplode_outer(split_words(F.col("text"))).alias("pos", "w"))
    found = words.select("doc_id", "h", "pos", ascii_lower(F.col("w")).alias("term")).join(terms, "term")
    lists = found.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.collect_set(F.struct("pos", "term")).alias("places"))
    back = keyed.join(lists, keyed.doc_id.eqNullSafe(lists.d) & (keyed.h == lists.k))
    return back.select("doc_id", "h", split_words(F.col("text")).alias("all"), "places").select("doc_id", "h", "all", F.inline("places"))


def postings(keyed: DataFrame, terms: DataFrame, width: int, few: bool = True) -> DataFrame:
    """The index: ``(term, doc_id, h, pos, before, after)`` of each occurrence of a wanted term; ``before`` is nearest first.
    ``few``: whether the terms are broadcast."""
    if not few:
        return surrounded(placed(keyed, terms), width)
    # the outer form: for the plain one Spark adds a filter on the list's size and splits every text twice
    words = keyed.select("doc_id", "h", split_words(F.col("text")).alias("all")).select("doc_id", "h", "all", F.posexplode_outer("all").alias("pos", "w"))
    return surrounded(words.withColumn("term", ascii_lower(F.col("w"))).join(terms, "term"), width)


def surrounded(found: DataFrame, width: int) -> DataFrame:
    """The words before and after each place."""
    back = F.least(F.col("pos"), F.lit(width - 1))
    near = found.select(
        "term",
        "doc_id",
        "h",
        "pos",
        F.reverse(F.slice("all", F.col("pos") - back + 1, back)).alias("before"),
        F.slice("all", F.col("pos") + 2, width - 1).alias("after"),
    )
    lowered = {c: F.transform(c, lambda w: F.translate(w, UPPER, LOWER)) for c in ("before", "after")}
    return near.withColumns(lowered)


def run(a: str, b: str) -> Column:
    """How many entries two lists have in common from their start."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def phrase_matches(index: DataFrame, tests: DataFrame, hint) -> DataFrame:
    """``(doc_id, h, item, first, last)``: runs of document words in which every word is in a window of the item."""
    pairs = index.join(hint(tests), "term").withColumns({"back": run("before", "left"), "ahead": run("after", "right")})
    return (
        pairs.filter(F.col("back") + F.col("ahead") + 1 >= F.col("need"))
        .select("doc_id", "h", "item", (F.col("pos") - F.col("back")).alias("first"), (F.col("pos") + F.col("ahead")).alias("last"))
        .distinct()
    )


def build(docs: DataFrame, items: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id", item_key: str = "item_id", most_broadcast: int = 1_000_000):
    """Keyed documents, stored index, test postings, and the hint for tables of test words."""
    keyed = doc_key(docs, text, key)
    wanted = stored(item_words(items, "text", item_key), "bench-items")
    rows = wanted.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]

    def hint(df):
        return small(df, rows, most_broadcast)

    vocabulary = wanted.select(F.explode("words").alias("term")).distinct()
    counts = stored(frequencies(keyed, hint(vocabulary)), "bench-counts")
    tests = stored(rarest(wanted, hint(counts), width), "bench-tests")
    index = stored(postings(keyed, hint(tests.select("term").distinct()), width, rows <= most_broadcast), "bench-index")
    return keyed, index, tests, hint


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id", item_key: str = "item_id", most_broadcast: int = 1_000_000) -> DataFrame:
    """Columns doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with a proximity match); one
    row per document."""
    keyed, index, tests, hint = build(docs, items, width, text, key, item_key, most_broadcast)
    runs = stored(phrase_matches(index, tests, hint), "bench-runs")
    places = runs.select("doc_id", "h", "first", "last").distinct()
    hits = places.select("doc_id", "h", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    listed = runs.groupBy(F.col("doc_id").alias("e"), F.col("h").alias("l")).agg(F.sort_array(F.collect_set("item")).alias("ids"))
    found = hits.join(listed, F.col("doc_id").eqNullSafe(F.col("e")) & (F.col("h") == F.col("l")))
    found = found.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "n_hit", "ids")
    near = proximity_matches(index, tests, hint).select("doc_id", "h", "item").distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_near"))
    near = near.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("ids"), "n_near")
    both = found.withColumn("n_near", F.lit(None).cast("long")).unionByName(near)
    found = both.groupBy("d", "k").agg(*(F.max(c).alias(c) for c in ("n_hit", "ids", "n_near")))
    counted = keyed.select("doc_id", "h", F.coalesce(F.regexp_count("text", F.lit(GAPLESS)), F.lit(0)).cast("long").alias("n_words"))
    joined = counted.join(found, counted.doc_id.eqNullSafe(found.d) & (counted.h == found.k), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id", item_key: str = "item_id", most_broadcast: int = 1_000_000) -> DataFrame:
    """The documents without any phrase match, with all their columns."""
    _, index, tests, hint = build(docs, items, width, text, key, item_key, most_broadcast)
    found = stored(phrase_matches(index, tests, hint).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct(), "bench-found")
    return docs.join(found, docs[key].eqNullSafe(found["_d"]) & (F.xxhash64(docs[text]) == found["_h"]), "left_anti")


#: A word before lower-casing, to count words.
GAPLESS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def proximity_matches(index: DataFrame, tests: DataFrame, hint, least: float = NEAR) -> DataFrame:
    """``(doc_id, h, item, pos, share)``: postings whose neighbours hold at least ``least`` of the distinct words that the
    item has around the same word, in any order."""
    around = F.array_distinct(F.concat("left", "right"))
    near = F.concat("before", "after")
    share = F.when(F.size(around) == 0, 1.0).otherwise(F.size(F.array_intersect(around, near)) / F.size(around))
    return index.join(hint(tests), "term").withColumn("share", share).filter(F.col("share") >= least).select("doc_id", "h", "item", "pos", "share").distinct()


SQL = r"""
WITH items AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(10, len(ws)) AS wide, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
docs AS (
  SELECT row_number() OVER () AS nr, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
places AS (
  SELECT nr, wide, i, array_to_string(ws[i:i + wide - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT wide FROM wins) w, unnest(range(1, len(ws) - wide + 2)) t(i)),
found AS (SELECT DISTINCT nr, item, p.wide, i FROM places p JOIN wins w ON p.wide = w.wide AND p.win = w.win),
hits AS (SELECT nr, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, wide)) t(k) GROUP BY nr),
listed AS (SELECT nr, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT nr, item FROM found) GROUP BY nr),
spots AS (SELECT nr, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
counts AS (SELECT term, count(*) AS n FROM spots GROUP BY term),
inner_words AS (
  SELECT item, ws, i, i + k AS p, ws[i + k] AS term
  FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i), unnest(range(0, least(10, len(ws)))) u(k) WHERE len(ws) > 0),
rare AS (
  SELECT item, ws, i, list(term ORDER BY coalesce(n, 0), term)[1] AS rare FROM inner_words LEFT JOIN counts USING (term) GROUP BY item, ws, i),
around AS (
  SELECT DISTINCT item, term, list_distinct(list_concat(ws[greatest(p - 9, 1):p - 1], ws[p + 1:p + 9])) AS wanted
  FROM inner_words JOIN rare USING (item, ws, i) WHERE term = rare),
near AS (
  SELECT nr, count(DISTINCT item) AS n_near
  FROM (SELECT nr, term, pos FROM spots WHERE term IN (SELECT term FROM around)) JOIN docs USING (nr) JOIN around USING (term)
  WHERE len(wanted) = 0 OR len(list_distinct(list_intersect(wanted, list_concat(ws[greatest(pos - 9, 1):pos - 1], ws[pos + 1:pos + 9])))) / len(wanted) >= 0.8
  GROUP BY nr)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM docs LEFT JOIN hits USING (nr) LEFT JOIN listed USING (nr) LEFT JOIN near USING (nr)
"""
