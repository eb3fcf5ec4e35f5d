import gzip
import hashlib
import io

from pyspark.sql import functions as F
from weatherloom.llm import warc
from weatherloom.llm.shared import table

LONG = "<p>" + "copy " * 60
ROWS = [
    (5, "http://www.Example.com:80/a?b=1#c", LONG),
    (3, "https://example.com/z", LONG),
    (9, None, LONG),
    (1, "http://b.org", "short"),
    (2, "http://b.org", "short"),
    (4, "not a url\twith tab\nand line", None),
    (6, "http://ü.de/ä b", "é" * 50),
    (7, "http://ü.de/ä b", "é" * 50),
    (None, "http://c.org/1", LONG),
    (3, "https://example.com/other", LONG),
    (8, "http://big.org/", "x" * 3_000_000),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    found = warc.round_trip(spark, pages(spark, ROWS)).collect()
    want = []
    first = {}
    for i, _, h in ROWS:
        data = (h or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(i, first.get(data, i))
    for i, _, h in ROWS:
        data = (h or "").encode()
        refers = first.get(data) if first.get(data) != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_look_ups_read_single_records(spark):
    folder = warc.new_path(spark, "warc-test")
    captures = warc.write_archives(pages(spark, ROWS), folder, file_bytes=500)
    directory = warc.build_index(captures, folder, block_lines=2)
    assert directory.agg(F.sum("captures")).first()[0] == len(ROWS)
    index = warc.CaptureIndex.load(directory, folder)
    for i, url, html in ROWS:
        got = [r for r in index.find(url) if r["page_id"] == i]
        assert len(got) == 1 and got[0]["payload_digest"] == hashlib.sha256((html or "").encode()).hexdigest()
    assert index.find("http://nobody.net/") == [] and index.find("zzz") == []
    assert index.payload(ROWS[0][1], 5, {3: "https://example.com/z"}) == LONG.encode()
    # the archives are plain gzip members with WARC records
    name = captures.filter("page_id = 1").first()
    system, top = warc.file_system(folder)
    with system.open_input_file(f"{top}/{name.file}") as f:
        assert gzip.GzipFile(fileobj=io.BytesIO(f.read())).read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_look_ups_of_a_table(spark):
    """Keys that escaping reorders, one url in most blocks, urls that nobody captured, other spellings of a url."""
    odd = [f"http://h.org/{c}" for c in ["a b", "a!b", "a\u00e9", "az", "a\"", "a~", "a|b", "\u4e2d", "%20", ""]]
    rows = [(i, odd[i % 10], f"page {i}") for i in range(60)] + [(100 + i, "http://hot.net/", f"hot {i}") for i in range(90)]
    df = pages(spark, rows)
    folder = warc.new_path(spark, "warc-test")
    parts = warc.build_index(warc.write_archives(df, folder), folder, block_lines=4)
    index = warc.CaptureIndex.load(parts, folder)
    assert len(list(index.blocks(warc.index_key("http://hot.net/")))) > 20
    for u in odd:
        assert sorted(r["page_id"] for r in index.find(u)) == [i for i, v, _ in rows if v == u]
    asked = spark.createDataFrame([(u,) for u in [odd[0], odd[0], "http://HOT.net:80#x", "http://no.where/", None]], "page_url string")
    got = warc.look_up(asked, parts, folder, url="page_url", rows_at_once=7).collect()
    want = {(i, h) for i, u, h in rows if u in (odd[0], "http://hot.net/")}
    assert len(got) == len(want) and {(r.page_id, bytes(r.payload).decode()) for r in got} == want
    assert warc.look_up(asked.limit(0), parts, folder, url="page_url").count() == 0


def test_keys():
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert warc.url_key("https://u@h.org:8443") == "org,h:8443)/"
    assert warc.url_key(None) == ")" and warc.url_key("odd") == ")odd"


def test_whole_table_and_empty_table(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    got = {r.page_id: r.payload_digest for r in warc.round_trip(spark, df).collect()}
    assert got == {r.page_id: r.d for r in df.select("page_id", F.sha2("html", 256).alias("d")).collect()}
    assert warc.round_trip(spark, pages(spark, [])).count() == 0
