"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming search, links confirmed on full sets.

A document's set is its distinct shingles of ``width`` words (A-Z lower-cased); a shorter text is one shingle. A
signature has ``chunks`` chunks of four 32-bit minima. By the pigeonhole principle two signatures that differ in at most
2 * chunks - 1 places agree in all but one place of some chunk, so every chunk is indexed under its four keys with one
place left out. All pairs within that distance (23 places of 48) share a key, that is guaranteed. At similarity 0.75 a pair
is further apart with a chance of about 2e-4; it is then still found unless every chunk differs in two places or more,
which leaves a chance of about 1e-7 that a pair at the threshold shares no key.

Pairs are never listed within a bucket of equal keys. First every member is compared with the bucket's smallest one.
The links found give groups; only buckets whose members are still in different groups are searched again, in blocks that
meet in a task. A bitmap of each set bounds the overlap of a pair from above, what remains is counted exactly on
the full sets there, and only links that join two groups leave the task.

Texts with equal words are one node from the start, by a 64-bit hash of the words. Null and empty texts have size 0,
no links, and are their own component. Null ids: linked as others are, never a component's id unless nobody else is there.
Repeated rows share a component. Empty table: no rows. Whole texts are used. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weatherloom.llm.shared import LOWER, UPPER, stored

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
PLACES = 4
BITS, LONGS = 1024, 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Shingles hashed at a time, so that a very long text needs no large matrix.
STEP = 1 << 12
#: Members of a bucket that meet in one task are two blocks of about this many at most.
BLOCK = 1024
#: The same for their full sets, in bytes.
BLOCK_BYTES = 1 << 24
WORDS_REMEMBERED = 100_000


def shingle_hashes(text: str | None, width: int, known: dict[bytes, int]) -> tuple[int | None, np.ndarray]:
    """A hash of the word sequence (None without words) and the sorted distinct 64-bit hashes of its shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not words:
        return None, np.zeros(0, np.uint64)
    if len(known) > WORDS_REMEMBERED:
        known.clear()
    ids = np.empty(max(len(words), width), np.uint64)
    ids[len(words) :] = 0
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w) | 1
        ids[i] = h
    mixed = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ ids[k : k + len(mixed)]) * MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    return xxhash.xxh64_intdigest(b" ".join(words), 17) - (1 << 63), np.unique(mixed)


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signature: for each hash function the least of its top 32 bits over the set."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), STEP):
        part = shingles[at : at + STEP, None] * a + b
        np.minimum(least, (part.min(0) >> np.uint64(32)).astype(np.uint32), out=least)
    return least.view(np.int32)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """1024 bits, one set for each shingle."""
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(bits).view(np.int64)


def signatures(docs: DataFrame, width: int, chunks: int) -> DataFrame:
    """Per document: id, hash of the text, node (null without words), n_shingles, signature, bits."""
    a, b = coefficients(PLACES * chunks)

    @F.pandas_udf("node long, n_shingles long, signature array<int>, bits array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for texts in batches:
            nodes, sizes, signs, maps = [], [], [], []
            for text in texts:
                node, s = shingle_hashes(text, width, known)
                nodes.append(node)
                sizes.append(len(s))
                signs.append(minima(s, a, b) if len(s) else None)
                maps.append(bitmap(s) if len(s) else None)
            # 64-bit hashes with gaps: a plain column would turn to floating point
            yield pd.DataFrame({"node": pd.array(nodes, "Int64"), "n_shingles": sizes, "signature": signs, "bits": maps})

    return docs.select("doc_id", F.xxhash64("text").alias("h"), sign("text").alias("s")).select("doc_id", "h", "s.*")


def chunk_keys(chunks: int) -> Column:
    """The keys of a signature: each chunk without one of its places, in all ways."""
    keys = []
    for c in range(chunks):
        for out in range(PLACES):
            kept = [F.col("signature")[c * PLACES + p] for p in range(PLACES) if p != out]
            keys.append(F.xxhash64(F.lit(c * PLACES + out), *kept))
    return F.array(*keys)


def can_reach(a: str, b: str, least: int) -> Column:
    """Whether the bitmaps allow the similarity (percent). Places where two bitmaps differ are as many elements that only
    one set has, so the overlap is at most (n_a + n_b - differing) / 2."""
    differing = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(LONGS)), F.lit(0))
    total = F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")
    # overlap / (total - overlap) >= least / 100, with overlap <= (total - differing) / 2
    return (100 + least) * (total - differing) >= 2 * least * total


def buckets(nodes: DataFrame, chunks: int) -> DataFrame:
    """``(key, node, n_shingles, center)`` of all keys that two nodes or more share; the center is the smallest node."""
    keyed = nodes.select(F.explode(chunk_keys(chunks)).alias("key"), "node", "n_shingles")
    shared = keyed.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).filter("center < last")
    return keyed.join(shared.drop("last"), "key")


def star_pairs(members: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Pairs of each bucket's center and its other members that the bitmaps allow."""
    light = nodes.select("node", "n_shingles", "bits")
    pairs = members.filter("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    left, right = light.alias("x"), light.alias("y")
    return pairs.join(left, F.col("a") == F.col("x.node")).join(right, F.col("b") == F.col("y.node")).filter(can_reach("x", "y", least)).select("a", "b")


def full_sets(ids: DataFrame, docs: DataFrame, nodes: DataFrame, rows: int, width: int, most_broadcast: int) -> DataFrame:
    """``(node, shingles)`` of the nodes in ``ids``, made from the first text of each; ids and text hashes are
    broadcast where there are at most ``most_broadcast``, else Spark joins by shuffle. ``rows``: number of nodes."""
    wanted = ids.join(nodes.select("node", F.col("head.doc_id").alias("id"), F.col("head.h").alias("of_text")), "node")
    wanted = stored(wanted, "near-ids", rows)
    hint = F.broadcast(wanted) if wanted.count() <= most_broadcast else wanted

    def full(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            found = []
            for node, text in zip(batch["node"], batch["text"]):
                own, s = shingle_hashes(text, width, known)
                if own == node:
                    found.append((node, s.view(np.int64)))
            yield pd.DataFrame(found, columns=["node", "shingles"])

    texts = docs.join(hint, docs.doc_id.eqNullSafe(F.col("id")) & (F.xxhash64(docs.text) == F.col("of_text"))).select("node", "text")
    return stored(texts.mapInPandas(full, "node long, shingles array<long>").dropDuplicates(["node"]), "near-sets", rows)


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, rows: int, width: int, least: int, most_broadcast: int) -> DataFrame:
    """The pairs whose full sets are similar enough; pairs grow with the nodes only, as they are those of centers."""
    pairs = stored(pairs, "near-pairs", 8 * rows)  # finding them is the work, so more tasks than their number asks for
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, nodes, rows, width, most_broadcast)
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("s", "t")))
    return both.filter(100 * F.col("common") >= least * (F.size("s") + F.size("t") - F.col("common"))).select("a", "b")


def open_blocks(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, lo, hi, node, label, size, bits, signature)``: the members of buckets that are still in different groups,
    each bucket cut into blocks by a hash of the node, for every two blocks (or one) that have to meet.

    Centers were compared already; a bucket whose other members are all in one group has nothing left to compare."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = labelled.filter("node != center")
    sizes = rest.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("all")).filter("first < last")
    rows = rest.join(sizes.select("key", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all") * 8 / BLOCK_BYTES)).alias("blocks")), "key")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int").alias("own")
    rows = rows.select("key", "node", "label", own, F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"))
    rows = rows.select("key", "node", "label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return rows.join(nodes.select("node", F.col("n_shingles").alias("size"), "bits", "signature"), "node")


def candidates(labels: np.ndarray, sizes: np.ndarray, bits: np.ndarray, signs: np.ndarray, least: int, most_differing: int) -> Iterator[np.ndarray]:
    """Pairs of positions (first < second) in different groups, within the signature distance, that sizes and bitmaps allow."""
    order = np.argsort(sizes, kind="stable")
    labels, sizes, bits, signs = labels[order], sizes[order], bits[order], signs[order]
    for i in range(len(sizes)):
        # sizes ascend: those from i + 1 on, up to the largest that can be similar
        to = int(np.searchsorted(sizes, sizes[i] * 100 / least, "right"))
        j = np.flatnonzero(labels[i + 1 : to] != labels[i]) + i + 1
        if not len(j):
            continue
        total = sizes[i] + sizes[j]
        differing = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
        j = j[(100 + least) * (total - differing) >= 2 * least * total]
        j = j[(signs[j] != signs[i]).sum(1) <= most_differing]
        if len(j):
            yield np.sort(np.stack([np.full(len(j), order[i]), order[j]], 1), 1)


def block_lists(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each two blocks that meet, with a list for every column; a list has about 2 * BLOCK entries at most."""
    packed = rows.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct(*columns)).alias("m"), F.min("label").alias("first"), F.max("label").alias("last"))
    return packed.filter("first < last").select("key", "lo", "hi", *[F.col(f"m.{c}").alias(c) for c in columns])


def unpacked(row: dict) -> tuple[np.ndarray, ...]:
    """Nodes, labels, sizes, bitmaps and signatures of a row of ``block_lists``."""
    plain = [np.asarray(row[c], np.int64) for c in ("node", "label", "size")]
    return *plain, np.stack([np.asarray(b, np.int64).view(np.uint64) for b in row["bits"]]), np.stack([np.asarray(x, np.int32) for x in row["signature"]])


def crossing_links(members: DataFrame, docs: DataFrame, nodes: DataFrame, labels: DataFrame, rows: int, width: int, least: int, most_differing: int, most_broadcast: int) -> DataFrame:
    """Links between different groups, enough to join them as all links would.

    Blocks of a bucket meet in a task. A first pass finds the nodes that have any candidate; full sets are made for those
    only. A second pass compares the full sets of the candidates in the task and gives a link where it joins two groups that
    are still apart there, so there are fewer links than members, and no pairs travel."""
    light = ("node", "label", "size", "bits", "signature")
    blocks = stored(open_blocks(members, nodes, labels), "near-blocks")

    def wanted(batches):
        for batch in batches:
            keys, los, his, found = [], [], [], []
            for row in batch.to_dict("records"):
                node, label, size, bits, signs = unpacked(row)
                pairs = list(candidates(label, size, bits, signs, least, most_differing))
                if pairs:
                    chosen = node[np.unique(np.concatenate(pairs))]
                    found.append(chosen)
                    for column, value in ((keys, row["key"]), (los, row["lo"]), (his, row["hi"])):
                        column.append(np.full(len(chosen), value))
            if found:
                yield pd.DataFrame({"key": np.concatenate(keys), "lo": np.concatenate(los), "hi": np.concatenate(his), "node": np.concatenate(found)})

    chosen = stored(block_lists(blocks, *light).mapInPandas(wanted, "key long, lo int, hi int, node long"), "near-wanted", rows)
    sets = full_sets(chosen.select("node").distinct(), docs, nodes, rows, width, most_broadcast)

    def links(batches):
        for batch in batches:
            left, right = [], []
            for row in batch.to_dict("records"):
                node, label, size, bits, signs = unpacked(row)
                sets = [np.asarray(s, np.int64) for s in row["shingles"]]
                group = {int(x): int(x) for x in label}

                def top(x):
                    while group[x] != x:
                        group[x] = group[group[x]]
                        x = group[x]
                    return x

                for pairs in candidates(label, size, bits, signs, least, most_differing):
                    for i, j in pairs:
                        x, y = top(int(label[i])), top(int(label[j]))
                        if x == y:
                            continue
                        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * common >= least * (len(sets[i]) + len(sets[j]) - common):
                            group[max(x, y)] = min(x, y)
                            left.append(node[i])
                            right.append(node[j])
            if left:
                yield pd.DataFrame({"a": left, "b": right})

    full = blocks.join(chosen, ["key", "lo", "hi", "node"]).join(sets, "node")
    return block_lists(full, *light, "shingles").mapInPandas(links, "a long, b long")


def components(links: DataFrame, rows: int) -> DataFrame:
    """``(node, label)`` for all nodes with links: the smallest node that can be reached.

    Each round takes the least label among neighbours and then the label of that label, and is stored; the number of
    rounds grows with the logarithm of a group's diameter. ``rows``: about how many nodes there are.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges", rows)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "near-labels", rows)
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        step = stored(lower.join(jump, "to", "left").select("node", "was", F.least("to", "further").alias("label")), "near-labels", rows)
        labels = step.select("node", "label")
        if step.filter("label != was").isEmpty():
            return labels


def grouped(
    docs: DataFrame,
    width: int = 5,
    least: int = 75,
    chunks: int = 12,
    most_differing: int = 30,
    text: str = "text",
    key: str = "doc_id",
    most_broadcast: int = 1_000_000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, ``(node, label)`` of all nodes, and ``(label, head)``: the row that stands for each component, by
    smallest id (null last), then text hash.

    ``least`` is the similarity in percent. Pairs whose signatures differ in more than ``most_differing`` places are not
    counted out exactly; at similarity 0.75 that is six standard deviations from the mean."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signatures(docs, width, chunks), "near-signatures")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("head")
    nodes = signed.filter("node is not null").groupBy("node").agg(
        head, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bits").alias("bits")
    )
    nodes = stored(nodes, "near-nodes")
    rows = nodes.count()
    members = stored(buckets(nodes, chunks), "near-members", PLACES * rows)
    stars = stored(confirmed(star_pairs(members, nodes, least), docs, nodes, rows, width, least, most_broadcast), "near-links", rows)
    labels = components(stars, rows)
    crossing = stored(crossing_links(members, docs, nodes, labels, rows, width, least, most_differing, most_broadcast), "near-links", rows)
    if not crossing.isEmpty():
        labels = components(stars.union(crossing), rows)
    of_node = nodes.select("node", "head").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return signed, of_node.select("node", "label"), of_node.groupBy("label").agg(F.min("head").alias("head"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Columns doc_id, n_shingles, component_id (smallest id reachable over links) and kept (it is the id itself). Several
    rows of a component can have its id, or none at all; ``one_of_each`` chooses between them. Options as in ``grouped``."""
    signed, of_node, heads = grouped(docs, **options)
    named = of_node.join(heads, "label").select(F.col("node").alias("of"), F.col("head.doc_id").alias("component_id"))
    found = signed.select("doc_id", "node", "n_shingles").join(named, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One document of each component, by smallest id, then text hash: of texts with one id or with null ids too. Documents
    without words stay. Rows that repeat id and text are dropped."""
    signed, _, heads = grouped(docs, text=text, key=key, **options)
    rows = heads.select("head.doc_id", "head.h").union(signed.filter("node is null").select("doc_id", "h"))
    kept = rows.select(F.col("doc_id").alias("_id"), F.col("h").alias("_of"))
    # the row travels as one column, whatever its columns are called
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_d"), F.xxhash64(text).alias("_h"))
    once = marked.join(kept, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_of")), "left_semi")
    return once.dropDuplicates(["_d", "_h"]).select("_row.*")
