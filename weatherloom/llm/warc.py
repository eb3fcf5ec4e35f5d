"""WARC archives of pages with a two-level capture index.

``write_archives`` writes one gzip member per record; pages with equal payloads become revisits of the first.
``build_index`` sorts the captures by reversed-host URL key into compressed blocks of lines. Each index file ends with its
part of the sparse block directory, and one row a file tells its keys. ``CaptureIndex`` binary-searches files, directory
part and the block's lines, and reads the record's bytes. ``look_up`` does so for a table of urls: distinct keys are
range-partitioned, so that a task needs few directory parts, and the blocks found are read in tasks of their own.

Null html: empty payload. Null or odd urls: the key is ")" and the url as it is. Urls that nobody captured have no rows,
repeated ones are looked up once, and of one key all captures come. Null page ids: the record's id is
"null"; such a page can be a revisit but is never the page that others revisit. Rows that repeat the id and payload of a
response are responses too. Empty table: empty archives. Long payloads are streamed into the file record by record.
Extra columns are ignored.

Files go to the shared folder, under names of their own for every attempt of a task; only finished attempts are indexed.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weatherloom.llm.shared import new_path, stored

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
CAPTURES = "key string, page_id long, file string, offset long, length long, digest string, kind string"
#: One row for each index file: its keys, and where its part of the block directory lies.
PARTS = "first_key string, last_key string, file string, offset long, length long, captures long"
BLOCKS = "key string, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a Hadoop-style address."""
    local = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.Example.com:80/a?b#c gives com,example,www)/a?b."""
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^#]*)", url or "")
    if not found:
        return ")" + (url or "")
    host, port, rest = found.groups()
    port = f":{port}" if port and port not in ("80", "443") else ""
    return ",".join(reversed(host.lower().rstrip(".").split("."))) + port + ")" + (rest if rest.startswith("/") else "/" + rest)


def index_key(url: str | None) -> str:
    """The key as ASCII, so that its order is the same in Spark, in Python and in the index."""
    return quote(url_key(url), safe=";/?:@&=+$,-_.!~*'()%#[]", errors="surrogatepass")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response or revisit record. A revisit keeps the HTTP head with the payload's length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {re.sub('[\\r\\n]', lambda m: quote(m[0]), url)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + body + END


def parsed(raw: bytes) -> dict:
    """Fields of a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (none for
    revisits). The payload of a response is checked against its digest."""
    head, _, rest = raw.partition(END)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(body) :] != END:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    http, _, payload = body.partition(END)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields.get("WARC-Refers-To")),
        "payload": payload if response else None,
    }


def page_of(identifier: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", identifier or "")
    return int(found[1]) if found else None


def with_roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with digest and ``refers_to``. Duplicates are found among light rows of id and digest; the html moves once,
    spread by page id."""
    payload = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    light = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).filter(F.col("size") >= least_bytes)
    first = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    again = light.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    return full.join(again, full.page_id.eqNullSafe(again.p) & (full.digest == again.d), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, level: int = 2, file_bytes: int = 1 << 30) -> DataFrame:
    """Writes every page and returns the captures: where each record lies. Each task writes files of its own."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = file_system(folder)
        system.create_dir(top, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, text, digest, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["refers_to"]):
                    page_id, refers = none_or_int(page_id), none_or_int(refers)
                    data = gzip.compress(record(page_id, url, text.encode("utf-8", "surrogatepass"), digest, refers), level, mtime=0)
                    if out is None or at + len(data) > file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{top}/{name}", compression=None)
                    out.write(data)
                    rows.append((index_key(url), page_id, name, at, len(data), digest, "response" if refers is None else "revisit"))
                    at += len(data)
                yield with_ids(rows, ["key", "page_id", "file", "offset", "length", "digest", "kind"])
        finally:
            if out is not None:
                out.close()

    # ids go as text: pandas turns integers with gaps into floating point
    roles = with_roles(pages, least_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return stored(roles.mapInPandas(write, CAPTURES), "warc-captures")


def none_or_int(value) -> int | None:
    return None if value is None else int(value)


def with_ids(rows: list, columns: list[str]) -> pd.DataFrame:
    """A frame whose id columns stay integers where some are missing."""
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    return frame.astype({c: "Int64" for c in ("page_id", "refers_to") if c in columns})


def line_of(row) -> str:
    return "\t".join([row.key, row.page_id or "null", row.kind, row.digest, row.file, str(row.offset), str(row.length)])


def build_index(captures: DataFrame, folder: str, block_lines: int = 3000) -> DataFrame:
    """Sorts the captures by key into compressed blocks. Each file ends with its directory part: a line of first key, last
    key, offset and length for every block. Returns one row a file, at most one for each range of the sort."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = file_system(folder)
        system.create_dir(top, recursive=True)
        name, at, waiting, blocks, out, count = f"captures-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx.gz", 0, [], [], None, 0

        def append(lines: list[str]) -> int:
            nonlocal at
            data = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(data)
            at += len(data)
            return len(data)

        def flush() -> None:
            nonlocal count
            start, size = at, append([line_of(r) for r in waiting])
            blocks.append((waiting[0].key, waiting[-1].key, start, size))
            count += len(waiting)
            waiting.clear()

        try:
            for batch in batches:
                out = out or system.open_output_stream(f"{top}/{name}", compression=None)
                for row in batch.itertuples(index=False):
                    waiting.append(row)
                    if len(waiting) == block_lines:
                        flush()
            if waiting:
                flush()
            if blocks:
                start, size = at, append(["\t".join(map(str, b)) for b in blocks])
        finally:
            if out is not None:
                out.close()
        if blocks:
            yield pd.DataFrame([(blocks[0][0], blocks[-1][1], name, start, size, count)], columns=["first_key", "last_key", "file", "offset", "length", "captures"])

    captures = captures.withColumn("page_text", F.col("page_id").cast("string"))
    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    ordered = ordered.drop("page_id").withColumnRenamed("page_text", "page_id")
    return stored(ordered.mapInPandas(write, PARTS), "warc-parts")


class CaptureIndex:
    """Look-ups by key. Holds the list of index files, one directory part and one block at a time."""

    def __init__(self, folder: str, parts: list[tuple]):
        self.system, self.top = file_system(folder)
        self.opened: dict = {}
        self.parts = sorted(tuple(p)[:5] for p in parts)
        self.bounds = bounds_of(self.parts)
        self.part: tuple = (None, [], ([], []))
        self.block: tuple = (None, [], [])

    @classmethod
    def load(cls, parts: DataFrame, folder: str) -> CaptureIndex:
        """The rows of ``build_index`` are as many as its sort had ranges, whatever the number of captures."""
        return cls(folder, parts.collect())

    def read(self, file: str, offset: int, length: int) -> bytes:
        """A range of a file; at most 64 files stay open."""
        path = f"{self.top}/{file}"
        if path not in self.opened:
            if len(self.opened) >= 64:
                self.opened.pop(next(iter(self.opened))).close()
            self.opened[path] = self.system.open_input_file(path)
        self.opened[path].seek(offset)
        return self.opened[path].read(length)

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of each block that can hold a key: files by binary search, then their blocks."""
        for _, _, file, offset, length in self.parts[holding(self.bounds, key)]:
            if self.part[0] != file:
                lines = [line.split("\t") for line in gzip.decompress(self.read(file, offset, length)).decode().split("\n")]
                self.part = (file, [(file, int(start), int(size)) for _, _, start, size in lines], bounds_of(lines))
            yield from self.part[1][holding(self.part[2], key)]

    def places(self, block: tuple[str, int, int], key: str) -> list[tuple[str, int, int]]:
        """Archive, offset and length of a key's records in a block, by binary search among its lines."""
        if self.block[0] != block:
            lines = gzip.decompress(self.read(*block)).decode().split("\n")
            self.block = (block, [line.split("\t", 1)[0] for line in lines], lines)
        _, keys, lines = self.block
        found = (line.split("\t") for line in lines[bisect_left(keys, key) : bisect_right(keys, key)])
        return [(file, int(offset), int(length)) for *_, file, offset, length in found]

    def record(self, place: tuple[str, int, int]) -> dict:
        return parsed(zlib.decompress(self.read(*place), 31))

    def find(self, url: str | None) -> list[dict]:
        """All records of a url."""
        key = index_key(url)
        return [self.record(place) for block in self.blocks(key) for place in self.places(block, key)]

    def payload(self, url: str | None, page_id: int, urls: dict[int, str]) -> bytes | None:
        """A page's payload; a revisit's is that of the page it refers to, whose url ``urls`` gives."""
        for r in self.find(url):
            if r["page_id"] == page_id:
                return r["payload"] if r["record_type"] == "response" else self.payload(urls[r["refers_to"]], r["refers_to"], urls)
        return None


def bounds_of(ordered: list) -> tuple[list[str], list[str]]:
    """First and last keys of parts or blocks; both lists ascend, since the captures were cut in their order."""
    return [o[0] for o in ordered], [o[1] for o in ordered]


def holding(bounds: tuple[list[str], list[str]], key: str) -> slice:
    """Where the key can be: from the first entry that does not end before it to the last that does not start after it."""
    return slice(bisect_left(bounds[1], key), bisect_right(bounds[0], key))


def look_up(urls: DataFrame, parts: DataFrame, folder: str, url: str = "url", with_payload: bool = True, captures_per_task: int = 50_000, rows_at_once: int = 10_000) -> DataFrame:
    """Every record of the given urls. A url that fills many blocks is read by many tasks, since a row of work is a key in
    one block."""
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    known = [tuple(p) for p in parts.collect()]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": [index_key(u) for u in batch["url"]]}, dtype=object)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, rows = CaptureIndex(folder, known), []
        for batch in batches:
            for key in batch["key"]:
                for block in index.blocks(key):
                    rows.append((key, *block))
                    if len(rows) == rows_at_once:
                        yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])
                        rows = []
        yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CaptureIndex(folder, [])
        for batch in batches:
            rows, size = [], 0
            work = zip(batch["key"], batch["file"], batch["offset"], batch["length"])
            for block, wanted in groupby(work, lambda w: w[1:]):
                for place in sorted(p for key, *_ in wanted for p in index.places(block, key)):
                    found = index.record(place)
                    if not with_payload:
                        found["payload"] = None
                    rows.append(found)
                    size += len(found["payload"] or b"")
                    if size > 1 << 25 or len(rows) == rows_at_once:
                        yield with_ids(rows, columns)
                        rows, size = [], 0
            yield with_ids(rows, columns)

    wanted = urls.select(F.col(url).alias("url")).mapInPandas(keys, "key string").distinct()
    blocks = stored(wanted.repartitionByRange("key").sortWithinPartitions("key").mapInPandas(search, BLOCKS), "warc-wanted")
    tasks = max(urls.sparkSession.sparkContext.defaultParallelism, -(-sum(p[5] for p in known) // captures_per_task))
    ordered = blocks.repartition(max(1, min(tasks, blocks.count())), "file", "offset").sortWithinPartitions("file", "offset", "key")
    return ordered.mapInPandas(read, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, least_bytes: int = 100) -> tuple[str, DataFrame]:
    """Writes archives and index; returns their folder and the index files."""
    folder = new_path(spark, "warc")
    return folder, build_index(write_archives(pages, folder, least_bytes), folder)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages and looks every one up again by its url."""
    folder, parts = archive(spark, pages)
    back = look_up(pages, parts, folder, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100
"""
