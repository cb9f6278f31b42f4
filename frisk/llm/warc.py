"""WARC archives: writing, reading back, and merging capture indexes.

Writing: equal payloads are found by digest; the smallest page id keeps the payload, the others refer to it.  Archives are
written by Spark's own text sink, whose line separator is the blank lines that end a WARC record, so any file system works.
Reading: each archive is parsed by the records' lengths.  The captures of an archive are sorted where they are read, which
gives locally sorted runs; runs are dealt out by ranges of (URL key, timestamp, page id) and a loser tree merges the k runs
of a range, so the ranges in order are the global capture history.  A URL with very many captures spans several ranges.
"""

from __future__ import annotations

import hashlib
import base64
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frisk.functions.keep import folder, stored

END = "\r\n\r\n"
RECORDS_PER_ARCHIVE, CAPTURES_PER_RANGE = 5_000, 200_000
CRAWL_TIME = "1970-01-01T00:00:00Z"
#: fixed values: base-32 digits of RFC 4648, and those that conv() writes
_BASE32, _CONV = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: five hexadecimal digits are four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _CONV, _BASE32)


def with_references(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                    time_col: str | None = None, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, date, payload, bytes, digest, refers_to): refers_to is null for records that keep their payload.

    Payloads shorter than ``min_bytes`` always stay.  A null payload is an empty one.  Rows without an id keep theirs, and so
    do repeated rows of the smallest id.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        (F.coalesce(F.col(time_col).cast("string"), F.lit(CRAWL_TIME)) if time_col else F.lit(CRAWL_TIME)).alias("date"),
                        F.coalesce(F.col(payload_col), F.lit("").cast(pages.schema[payload_col].dataType)).cast("binary").alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    first = rows.select("digest", "bytes", "page_id").groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = stored(first.filter("n > 1").drop("n"))  # own table: its real size is known when the join is planned
    joined = rows.join(copied, ["digest", "bytes"], "left")
    refers = F.when((F.col("bytes") >= min_bytes) & (F.col("page_id") != F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "date", "payload", "bytes", "digest", refers.alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def record(row: str = "") -> Column:
    """A WARC/1.1 record without the blank lines that end it."""
    c = lambda name: F.col(row + name)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), c("bytes").cast("string"), F.lit(END))
    block = F.when(c("refers_to").isNull(), F.concat(http.cast("binary"), c("payload"))).otherwise(http.cast("binary"))
    url = F.regexp_replace(c("url"), "[\\x00-\\x20\\x7f]", "%20")  # a header is one line
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(c("refers_to").isNull(), "response").otherwise("revisit")),
        _line("WARC-Record-ID", name(c("page_id"))), _line("WARC-Date", c("date")), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest"))),
        F.when(c("refers_to").isNotNull(), F.concat(_line("WARC-Refers-To", name(c("refers_to"))),
               _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"))
    return F.concat(head.cast("binary"), block)


def write_archives(records: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """One gzip archive per task and ``records_per_archive`` records; bytes of payloads are written as they are."""
    (records.select(record().cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_archive).text(path))


def url_key(url: str) -> str:
    """The URL with its host reversed, without scheme, www, default port, user and fragment; a URL that can't be split stays as it is."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    port = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/").lower() + (f"?{parts.query}" if parts.query else "")


_HEADER = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def records_in(archive: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, headers, block) of each record of an inflated archive, cut by the stated lengths."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        body = archive.index(b"\r\n\r\n", at) + 4
        headers = {k.lower(): v for k, v in _HEADER.findall(archive[at:body])}
        end = body + int(headers[b"content-length"])
        yield at, headers, bytes(view[body:end])
        at = end + 4


_CDX = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, run long"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per reading task.  Payloads of responses are hashed again and must match their header."""
    def parse(batches):
        found, run = [], TaskContext.get().partitionId()
        page = lambda v: int(v[10:-1]) if v and len(v) > 11 else None
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, head, block in records_in(zlib.decompress(content.as_buffer(), 31)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(dict(_HEADER.findall(http)).get(b"Content-Length", b"0"))
                    kind, digest = head[b"warc-type"].decode(), head[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name} at {at}: the payload differs from its header")
                    found.append((url_key(head.get(b"warc-target-uri", b"").decode()), head[b"warc-date"].decode(), page(head[b"warc-record-id"]), n, digest,
                                  kind, page(head.get(b"warc-refers-to")), name.rpartition("/")[2], at, run))
        found.sort(key=_order)
        yield from _batches(found)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(parse, _CDX)


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2]


def _batches(rows: list[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in _CDX.split(", "))])
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows[k:k + size]), schema)], schema=schema)


def merged(runs: list[Iterator], order: Callable = _order) -> Iterator:
    """k sorted runs as one: a loser tree, one comparison per level for each row that leaves."""
    done = object()
    heads = [next(r, done) for r in runs]
    keys = [None if h is done else order(h) for h in heads]
    k = len(runs)
    first = lambda a, b: keys[b] is None or keys[a] is not None and (keys[a], a) <= (keys[b], b)
    losers = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        losers[node] = b if first(a, b) else a
        return a if first(a, b) else b

    winner = play(1) if k > 1 else 0
    while k and keys[winner] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], done)
        keys[winner] = None if heads[winner] is done else order(heads[winner])
        node = (winner + k) // 2
        while node:
            if first(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def capture_history(runs: DataFrame, captures_per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """Captures in global order of (url_key, timestamp, page_id): ranges are ordered among themselves, each is merged from its runs.

    A range holds about ``captures_per_range`` rows, whatever the size of the table, so a merge holds as many.
    """
    n = runs.count()
    ranges = max(1, -(-n // captures_per_range), min(n // 1000, runs.sparkSession.sparkContext.defaultParallelism))
    dealt = runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id").sortWithinPartitions("run", "url_key", "timestamp", F.col("page_id").asc_nulls_first())

    def merge(batches):
        by_run: dict[int, list] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                by_run.setdefault(row[-1], []).append(row)
        yield from _batches(list(merged([iter(rows) for rows in by_run.values()])))
    return dealt.mapInArrow(merge, _CDX)


def archive_and_index(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as archives under ``path``, read them back and return their capture history.  Empty tables give an empty one."""
    path = path or folder(pages.sparkSession)
    write_archives(with_references(pages, **columns), path)
    return capture_history(stored(captures(pages.sparkSession, path)))
