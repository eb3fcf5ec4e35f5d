"""Fill-in-middle: texts are cut at two character ranks by a learned rank index and put together in another order.

The index maps the rank of a character to the byte where it starts. Straight segments are fitted to all boundaries of the
text so that no prediction is off by more than ``error`` bytes, and the difference is stored for every boundary. A cut is
predicted by its segment and corrected by the stored difference, so it is exact. A text of single bytes is one segment.

Null text: empty. Empty or marker-holding texts keep their form (``plain``). Null id: hashed as empty text. Long texts: the
index is fitted in pieces of STEP bytes. Repeated rows repeat. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes indexed at a time.
STEP = 1 << 20


class RankIndex:
    """Byte offset of every character rank, 0 to ``n`` (the end), as segments and differences of at most ``error``."""

    def __init__(self, data: bytes | memoryview, error: int = 100):
        if not 0 <= error <= 127:
            raise ValueError("differences are stored in one byte")
        seen = np.frombuffer(data, np.uint8)
        self.ranks, self.offsets, self.ends, self.end_offsets, differences = [], [], [], [], []
        rank = 0
        for at in range(0, len(seen), STEP):
            piece = np.flatnonzero((seen[at : at + STEP] & 0xC0) != 0x80) + at
            if len(piece):
                self._fit(piece, rank, error, differences)
                rank += len(piece)
        self.n = rank
        self._segment(rank, len(seen), rank, len(seen))
        differences.append(np.zeros(1, np.int8))
        self.differences = np.concatenate(differences)
        self.starts = np.array(self.ranks)

    def _segment(self, rank: int, offset: int, last: int, last_offset: int) -> None:
        self.ranks.append(rank)
        self.offsets.append(offset)
        self.ends.append(last)
        self.end_offsets.append(last_offset)

    def _fit(self, boundaries: np.ndarray, rank: int, error: int, differences: list[np.ndarray]) -> None:
        """Segments from left to right; one whose line is off by more than ``error`` is cut in half."""
        waiting = [(0, len(boundaries))]
        while waiting:
            lo, hi = waiting.pop()
            own = boundaries[lo:hi]
            first, last, count = int(own[0]), int(own[-1]), hi - lo
            line = first + (np.arange(count) * (last - first)) // max(1, count - 1)
            off = own - line
            if count > 2 and max(int(off.max()), -int(off.min())) > error:
                middle = (lo + hi) // 2
                waiting += [(middle, hi), (lo, middle)]
                continue
            self._segment(rank + lo, first, rank + hi - 1, last)
            differences.append(off.astype(np.int8))

    def predict(self, rank: int) -> int:
        s = int(np.searchsorted(self.starts, rank, "right")) - 1
        steps = max(1, self.ends[s] - self.ranks[s])
        return self.offsets[s] + ((rank - self.ranks[s]) * (self.end_offsets[s] - self.offsets[s])) // steps

    def offset(self, rank: int) -> int:
        """The byte at which character ``rank`` starts, exactly."""
        return self.predict(rank) + int(self.differences[rank])


def put_together(data: bytes, draws: tuple[int, int, int, int], rate: int, spm: int, error: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Characters, form, characters of prefix and middle, and the text in its form, all in UTF-8."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    index = RankIndex(data, error)
    n = index.n
    if not n or p in data or s in data or m in data or draws[2] % 100 >= rate:
        return n, "plain", None, None, data
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = index.offset(first), index.offset(second)
    if draws[3] % 100 < spm:
        return n, "spm", first, second - first, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", first, second - first, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, error: int = 100) -> DataFrame:
    """Columns ``key``, n, form (psm, spm or plain), prefix_chars, middle_chars, output (the text in its form).

    ``rate``: percent of texts that are cut; ``spm``: percent of those with the suffix first; both drawn from the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    given = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("data"), digest.alias("_h")).select("id", "data", *draws)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("data").cast(pa.binary())
            drawn = zip(*(b.column(f"h{i}").to_pylist() for i in (1, 2, 3, 4)))
            made = [put_together(t.as_py(), d, rate, spm, error) for t, d in zip(texts, drawn)]
            n, form, first, middle, output = zip(*made) if made else ([], [], [], [], [])
            columns = [b.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64())]
            columns.append(pa.array(output, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(given.dtypes)["id"]
    out = given.mapInArrow(rows, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", key)


def restored(output: Column, form: Column) -> Column:
    """The text from its form; markers cannot stand in the parts, so the first of each is the right one."""
    psm = F.split(F.substr(output, F.lit(4)), f"{SUFFIX}|{MIDDLE}", -1)
    spm = F.split(F.substr(output, F.lit(4)), f"{PREFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM hashed
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
                        WHEN 'spm' THEN '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a)
                        ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
