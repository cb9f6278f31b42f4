import base64
import hashlib
import random

from frisk.llm import warc
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, bytes string"
ROWS = [(3, "http://www.B.example:80/Path?q=1#x", "same\r\n\r\nWARC/1.1\r\n\r\n", "extra"), (1, "https://a.example/é x\r\ny", "same\r\n\r\nWARC/1.1\r\n\r\n", None),
        (2, None, None, None), (5, "", "", None), (4, "not a url", "née ☕ \x00", None), (None, "http://[bad", "no id", None), (9, "http://a.example", "same\r\n\r\nWARC/1.1\r\n\r\n", "")]


def _want(rows, least=0):
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, _ in rows:
        raw, one = (h or "").encode(), first.get(h or "")
        again = i is not None and i != one and len(raw) >= least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", one if again else None))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS + ROWS[:1], SCHEMA)
    assert _got(warc.archive_and_index(pages)) == _want(ROWS + ROWS[:1])
    assert _got(warc.archive_and_index(pages, min_bytes=3)) == _want(ROWS + ROWS[:1], 3)
    assert warc.archive_and_index(pages.limit(0)).count() == 0


def test_archives_hold_the_payload_bytes(spark, scratch):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    warc.write_archives(warc.with_references(pages), f"{scratch}/w", 2)
    files = spark.read.format("binaryFile").load(f"{scratch}/w").filter("path like '%.gz'").collect()
    import zlib
    found = [r for f in files for r in warc.records_in(zlib.decompress(f.content, 31))]
    bodies = [b.partition(b"\r\n\r\n")[2] for _, h, b in found if h[b"warc-type"] == b"response"]
    assert len(found) == len(ROWS) and sorted(bodies) == sorted([b"same\r\n\r\nWARC/1.1\r\n\r\n", b"", "née ☕ \x00".encode(), b"no id"])
    assert all(b == b"" for b in (b.partition(b"\r\n\r\n")[2] for _, h, b in found if h[b"warc-type"] == b"revisit"))


def test_history_is_globally_ordered(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".example/p")).alias("url"),
                                     F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("html")).repartition(9)
    rows = warc.capture_history(warc.captures(spark, _written(spark, pages)), 400)
    assert rows.rdd.getNumPartitions() > 4
    got = [(r.url_key, r.timestamp, r.page_id) for r in rows.collect()]
    assert got == sorted(got) and len(got) == 3000


def _written(spark, pages):
    from frisk.functions.keep import folder
    path = folder(spark)
    warc.write_archives(warc.with_references(pages), path)
    return path


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.choice([0, 1, 30]))) for _ in range(k)]
        assert list(warc.merged([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.B.example:80/Path?q=1#x") == "example,b)/path?q=1"
    assert warc.url_key("https://a.example:8080") == "example,a:8080)/" and warc.url_key("nothing") == "nothing" and warc.url_key("") == ""
