"""Class-based n-gram scores: exchange clustering of words, class transitions, word emissions.

Training: (1) all words are counted. (2) Words of at least a ``share``-th of all tokens move alone in the exchange, rarer
words move with all rare words of the same last three bytes (``endings`` buckets). These units are bounded at any size:
at most ``share`` words, since their shares add up to one, and ``endings``. (3) Transitions between units are counted over
all texts. (4) Exchange: every round weighs for each unit the change in likelihood of moving it to each class and moves the
half that gains most (moves made together disturb each other; when they do harm, half as many are tried). The
end of text is a unit and class of its own, and also the context of a first word.

Score of a token: P(class | class before) * P(word | class). Transitions are smoothed with the classes' own shares. A
class keeps the share of its words seen once for unknown words, which find their class by their ending. The
probabilities of all known words and one unknown word a class add up to one in every context.

Words with a large share of the tokens (``most_bytes`` of them in all, by their shares) are looked up in the tasks; the
others are joined, once for every document and word. Everything is learned from all rows and whole texts.

Null text: empty. A text without words has one token, the end. Null ids and repeated rows: scored like others. Empty
table: no rows; nothing to learn from: every word is unknown. Extra columns are ignored, except a clash with the result's
own names, which win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherloom.llm.shared import stored

END = ""
#: Columns of a stored piece of the transition table; bytes of text handled at a time.
CELLS, STEP = 64, 1 << 22
#: A word counts as this many bytes at least when the looked-up words are bounded.
LEAST_BYTES = 20


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about STEP bytes, null as empty; one longer text is a run of its own."""
    texts = pc.fill_null(texts, "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP, "right")))
        yield texts.slice(at, to - at)
        at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (A-Z lower-cased), and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    parents = np.repeat(np.arange(len(texts)), sizes)[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), np.bincount(parents, minlength=len(texts))


def endings(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for the last three bytes of each word."""
    found = np.zeros(len(words), np.uint64)
    if len(words):
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        for back in (1, 2, 3):
            at = offsets[1:] - back
            found = found * np.uint64(257) + np.where(at >= offsets[:-1], data[np.maximum(at, 0)], 0).astype(np.uint64)
    return ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


@dataclass
class Units:
    """What moves in the exchange: frequent ``words`` one by one, then the buckets of endings, then the end of text."""

    words: pa.Array
    buckets: int

    @property
    def end(self) -> int:
        return len(self.words) + self.buckets

    def of(self, words: pa.Array) -> np.ndarray:
        own = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        return np.where(own >= 0, own, len(self.words) + endings(words, self.buckets))


def sequence(units: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The units of all texts in a row, an end before, between and after them."""
    row = np.full(len(units) + len(sizes) + 1, end, np.int64)
    row[np.arange(len(units)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = units
    return row


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of the word at each place, words of each text."""
    words, sizes = words_of(texts)
    known = words.dictionary_encode()
    return known.dictionary, known.indices.to_numpy(zero_copy_only=False), sizes


def word_counts(texts: DataFrame) -> DataFrame:
    """``(w, n)`` of all words and of the end, which is the empty word."""

    def rows(batches):
        for b in batches:
            for piece in pieces(b.column(0)):
                found = pc.value_counts(words_of(piece)[0])
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["w", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([b.num_rows], pa.int64())], ["w", "n"])

    return texts.mapInArrow(rows, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 0")


def transition_counts(texts: DataFrame, units: Units) -> DataFrame:
    """``(a, block, c0 ...)``: how often unit ``a`` stands before each of the block's CELLS units."""
    end = units.end
    width = -(-(end + 1) // CELLS)

    def filled(total):
        cells = np.pad(total.reshape(end + 1, end + 1), ((0, 0), (0, width * CELLS - end - 1))).reshape(-1, CELLS)
        used = np.flatnonzero(cells.any(1))
        for at in range(0, len(used), 8192):
            rows = used[at : at + 8192]
            columns = [pa.array((rows // width).astype(np.int32)), pa.array((rows % width).astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in cells[rows].T)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "block", *(f"c{i}" for i in range(CELLS))])

    def rows(batches):
        total, seen = np.zeros((end + 1) ** 2, np.int32), 0
        for b in batches:
            for piece in pieces(b.column(0)):
                words, places, sizes = coded(piece)
                row = sequence(units.of(words)[places], sizes, end)
                total += np.bincount(row[:-1] * (end + 1) + row[1:], minlength=len(total)).astype(np.int32)
                seen += len(row)
                if seen > 1 << 30:
                    yield from filled(total)
                    total[:], seen = 0, 0
        yield from filled(total)

    cells = [f"c{i}" for i in range(CELLS)]
    counted = texts.mapInArrow(rows, "a int, block int, " + ", ".join(f"{c} long" for c in cells))
    return counted.groupBy("a", "block").agg(*[F.sum(c).alias(c) for c in cells])


def profiles(transitions: DataFrame, n: int) -> DataFrame:
    """``(unit, after, before)``: how often each unit stands after and before it; groups hold CELLS units."""
    cells = [f"c{i}" for i in range(CELLS)]

    def after(key, rows):
        full = np.zeros((CELLS, -(-n // CELLS) * CELLS), np.int64)
        for a, block, cell in zip(rows["a"], rows["block"], rows[cells].to_numpy()):
            full[a % CELLS, block * CELLS : (block + 1) * CELLS] = cell
        return listed(full[:, :n], key[0] * CELLS, "after")

    def before(key, rows):
        full = np.zeros((CELLS, n), np.int64)
        full[:, rows["a"].to_numpy()] = rows[cells].to_numpy().T
        return listed(full, key[0] * CELLS, "before")

    def listed(full, first, name):
        import pandas as pd

        used = np.flatnonzero(full.any(1))
        return pd.DataFrame({"unit": (first + used).astype(np.int32), name: [full[i] for i in used]})

    follow = transitions.groupBy(F.expr(f"a div {CELLS}").cast("int").alias("part")).applyInPandas(after, "unit int, after array<long>")
    lead = transitions.groupBy("block").applyInPandas(before, "unit int, before array<long>")
    return follow.join(lead, "unit")


def entropy_terms(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(counts: np.ndarray) -> float:
    """Log-likelihood of class transitions and emissions, without the part that no exchange changes."""
    return float(entropy_terms(counts).sum() - entropy_terms(counts.sum(0)).sum() - entropy_terms(counts.sum(1)).sum())


def gains(counts: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, self_pairs: float) -> np.ndarray:
    """Likelihood with the unit in each class, up to a constant. ``after`` and ``before``: its counts by class."""
    rest = counts.copy()
    rest[own] -= after
    rest[:, own] -= before
    rest[own, own] += self_pairs
    s, p = after.copy(), before.copy()
    s[own] -= self_pairs
    p[own] -= self_pairs
    old = entropy_terms(rest)
    row, column = entropy_terms(rest + s) - old, entropy_terms(rest + p[:, None]) - old
    diagonal = np.diag(rest)
    found = row.sum(1) - np.diag(row) + column.sum(0) - np.diag(column) + entropy_terms(diagonal + s + p + self_pairs) - np.diag(old)
    left, right = rest.sum(1) + p, rest.sum(0) + s  # pairs with the unit count for the other side's class too
    return found - (entropy_terms(left + after.sum()) - entropy_terms(left)) - (entropy_terms(right + before.sum()) - entropy_terms(right))


def arrays(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, n).astype(np.float64)


def class_counts(table: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Transitions between classes, (k + 1) x (k + 1); the last is the end."""

    def rows(batches):
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            if b.num_rows:
                own = classes[b.column("unit").to_numpy()]
                np.add.at(total, own, np.array([np.bincount(classes, r, k + 1) for r in arrays(b.column("after"), len(classes))]))
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[c, d].astype(np.int64))], ["c", "d", "n"])

    found = np.zeros((k + 1, k + 1))
    for r in table.select("unit", "after").mapInArrow(rows, "c int, d int, n long").groupBy("c", "d").agg(F.sum("n").alias("n")).collect():
        found[r["c"], r["d"]] = r["n"]
    return found


def wishes(table: DataFrame, classes: np.ndarray, counts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """``(unit, class)`` of the units that would be better elsewhere, most gain first; of equal classes the smallest."""
    end = len(classes) - 1

    def rows(batches):
        for b in batches:
            found = []
            for unit, after, before in zip(b.column("unit").to_numpy(), arrays(b.column("after"), end + 1), arrays(b.column("before"), end + 1)):
                by = [np.bincount(classes, x, k + 1) for x in (after, before)]
                all_gains = gains(counts, classes[unit], *by, after[unit])[:k]
                best = int(all_gains.argmax())
                if unit != end and all_gains[best] > all_gains[classes[unit]] + 1e-9 * after.sum():
                    found.append((int(unit), best, float(all_gains[best] - all_gains[classes[unit]])))
            if found:
                units, best, gain = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(best, pa.int32()), pa.array(gain)], ["unit", "best", "gain"])

    asked = table.filter(F.col("unit") != end).mapInArrow(rows, "unit int, best int, gain double").collect()
    return [(r["unit"], r["best"]) for r in sorted(asked, key=lambda r: (-r["gain"], r["unit"]))]


def exchange(table: DataFrame, n: int, k: int, rounds: int, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the ``n`` units, their transitions, and the likelihood at the start and after each round."""
    classes = np.arange(n) % k
    classes[-1] = k
    counts = class_counts(table, classes, k)
    history, parts = [likelihood(counts)], 2
    for _ in range(rounds):
        wanted = wishes(table, classes, counts, k)
        while wanted:
            moved = wanted[: -(-len(wanted) // parts)]
            tried = classes.copy()
            for unit, best in moved:
                tried[unit] = best
            seen = class_counts(table, tried, k)
            if likelihood(seen) > history[-1]:
                break
            wanted, parts = ([], parts) if len(moved) == 1 else (wanted, parts * 2)
        if not wanted:
            break
        classes, counts, parts = tried, seen, max(2, parts // 2)
        history.append(likelihood(counts))
        if history[-1] - history[-2] < least * abs(history[-1]):
            break
    return classes, counts, history


@dataclass
class ClassModel:
    """``words``: the table of all counts. ``near``, ``near_counts``: words looked up in tasks. Logarithms to base 10:
    ``moves`` between classes, ``known`` (added to a known word's log count) and ``unknown`` by class."""

    words: DataFrame
    near: pa.Array
    near_counts: np.ndarray
    units: Units
    classes: np.ndarray
    moves: np.ndarray
    known: np.ndarray
    unknown: np.ndarray
    tokens: int
    distinct: int
    ends: int
    history: list[float]

    @property
    def floor(self) -> float:
        """Denominator of the base score."""
        return self.tokens + 0.5 * (self.distinct + 1)


def once_seen(words: DataFrame, units: Units) -> np.ndarray:
    """Words counted once, by unit."""

    def rows(batches):
        total = np.zeros(units.end + 1, np.int64)
        for b in batches:
            total += np.bincount(units.of(b.column("w")), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["unit", "n"])

    found = np.zeros(units.end + 1)
    single = words.filter((F.col("n") == 1) & (F.col("w") != END)).select("w")
    for r in single.mapInArrow(rows, "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect():
        found[r["unit"]] = r["n"]
    return found


def train(
    docs: DataFrame, text: str = "text", k: int = 32, rounds: int = 12, share: int = 8192, buckets: int = 1024, smoothing: float = 32.0, most_bytes: int = 1 << 22
) -> ClassModel:
    """Learns from all rows. The driver gets at most ``share`` + ``buckets`` unit rows, (k + 1)^2 transitions and
    ``most_bytes`` of words with their counts."""
    texts = docs.select(text)
    words = stored(word_counts(texts), "class-words")
    about = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n"), F.coalesce(F.sum(F.when(F.col("w") == END, F.col("n"))), F.lit(0))).first()
    tokens, distinct, ends = (int(x) for x in about)
    size = F.greatest(F.octet_length("w"), F.lit(LEAST_BYTES)).cast("double")
    often = words.filter((F.col("w") != END) & (F.col("n") * float(most_bytes) >= size * float(tokens)))
    often = often.withColumn("alone", F.col("n") * float(share) * LEAST_BYTES >= size * float(tokens))
    got = often.toArrow().combine_chunks().sort_by([("n", "descending"), ("w", "ascending")])
    near = got["w"].combine_chunks() if len(got) else pa.array([], pa.string())
    near_counts = got["n"].to_numpy() if len(got) else np.zeros(0, np.int64)
    alone = got["alone"].combine_chunks() if len(got) else pa.array([], pa.bool_())
    units = Units(near.filter(alone), buckets)
    table = stored(profiles(stored(transition_counts(texts, units), "class-transitions"), units.end + 1), "class-profiles")
    classes, counts, history = exchange(table, units.end + 1, k, rounds)
    single = once_seen(words, units)
    of_class = counts.sum(0)
    once = np.bincount(classes, single, k + 1)
    seen = np.isin(np.arange(units.end + 1), [r["unit"] for r in table.select("unit").collect()])
    classes[~seen & (np.arange(units.end + 1) < units.end)] = int(once[:k].argmax())  # endings never seen: where most new words are
    lost = np.where(of_class > 0, (once + 0.5) / (of_class + 1), 1.0)
    lost[k] = 0
    shares = (of_class + 0.5) / (of_class + 0.5).sum()
    moves = (counts + smoothing * shares) / (counts.sum(1, keepdims=True) + smoothing)
    with np.errstate(divide="ignore"):
        known = np.log10(1 - lost) - np.log10(np.maximum(of_class, 1))
        unknown = np.log10(lost)
    return ClassModel(words, near, near_counts, units, classes, np.log10(moves), known, unknown, tokens, distinct, ends, history)


TAIL = "array<struct<w: string, times: int, class: int>>"
PARTIAL = f"row long, id {{}}, n_tokens long, n_known long, base double, score double, rest {TAIL}"


def partial_scores(docs: DataFrame, model: ClassModel) -> DataFrame:
    """Per row: sums over the end, over transitions and over words that tasks know, and the ``rest`` of its words."""
    near, units, classes, moves, floor = model.near, model.units, model.classes, model.moves, model.floor
    end, unknown_to_tasks = units.end, np.int64(-1)
    with_end = np.log10((model.ends + 0.5) / floor)
    ends_known = int(model.ends > 0)
    log_counts, of_base = np.log10(model.near_counts), np.log10((model.near_counts + 0.5) / floor)
    emission = model.known

    def rows(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            for piece in pieces(b.column("text")):
                words, places, sizes = coded(piece)
                n, parents = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
                spot = pc.fill_null(pc.index_in(words, value_set=near), unknown_to_tasks).to_numpy(zero_copy_only=False)
                unit = units.of(words)
                cls = classes[unit]
                there = spot >= 0
                base, emit = np.zeros(len(words)), np.zeros(len(words))
                base[there], emit[there] = of_base[spot[there]], log_counts[spot[there]] + emission[cls[there]]
                line = classes[sequence(unit[places], sizes, end)]
                score = np.bincount(np.repeat(np.arange(n), sizes + 1), moves[line[:-1], line[1:]], n)
                score += np.bincount(parents, emit[places], n)
                known = np.bincount(parents, there[places], n).astype(np.int64) + ends_known
                far = ~there[places]
                pairs, times = np.unique(parents[far] * max(1, len(words)) + places[far], return_counts=True)
                owner, which = pairs // max(1, len(words)), pairs % max(1, len(words))
                rest = pa.StructArray.from_arrays(
                    [words.take(pa.array(which)), pa.array(times.astype(np.int32)), pa.array(cls[which].astype(np.int32))], ["w", "times", "class"]
                )
                offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                columns = [pa.array(row + np.arange(n)), b.column("id").slice(at, n), pa.array(sizes + 1), pa.array(known)]
                columns += [pa.array(np.bincount(parents, base[places], n) + with_end), pa.array(score), pa.ListArray.from_arrays(offsets, rest)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_tokens", "n_known", "base", "score", "rest"])
                row, at = row + n, at + n

    return docs.mapInArrow(rows, PARTIAL.format(dict(docs.dtypes)["id"]))


def score(docs: DataFrame, model: ClassModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, n_tokens, n_known, train_tokens, base_score (smoothed shares of single words), score, perplexity."""
    given = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = stored(partial_scores(given, model), "class-scores")
    rest = rows.select("row", F.inline("rest")).join(model.words, "w", "left")
    lists = {name: F.array(*[F.lit(float(max(x, -1e300))) for x in values]) for name, values in (("known", model.known), ("unknown", model.unknown))}
    emitted = F.when(F.col("n").isNotNull(), F.log10("n") + F.get(lists["known"], F.col("class"))).otherwise(F.get(lists["unknown"], F.col("class")))
    sums = rest.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / model.floor)).alias("more_base"),
        F.sum(F.col("times") * emitted).alias("more_score"),
    )
    whole = rows.drop("rest").join(sums, "row", "left")
    total = (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score")
    found = whole.select(
        F.col("id").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        total,
    )
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
