"""WARC archives with revisit records, and their globally ordered capture index.

Records are built as text columns, put together to files of about FILE_BYTES and written by Spark's text writer: the two line
breaks that end a WARC record are its line separator, so files go through any store that Spark reaches. Each file is a run of
captures sorted by URL key, time and page. Reading parses records by Content-Length and recomputes payload digests. The index
is an external merge: captures, which have no payload, are dealt by ranges of (URL key, time, page, place) with about RANGE_ROWS
each, however many there are and however many equal ones, and in each range the parts of the sorted runs, which keep their
order, pass through a k-way loser tree. A run out of order raises.

Inputs: a null html is an empty payload; a null url has an empty URL key; null page_ids are captures of their own that
revisit an equal payload where a known page_id has it; rows that repeat the smallest page_id of a payload are all responses;
captures of equal key, time and page come in the order of run and offset; other columns are ignored; empty tables give an empty
result.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from .common import drop_path, fresh_path, lean, materialize

#: Bytes of a file, which is one row of the binary reader; it has one record more at most, and records of this size stand alone.
FILE_BYTES = 8 << 20
#: Captures of a range of the index, about; a range is merged by one task in memory.
RANGE_ROWS = 50_000
#: A payload that so many pages share is looked up with the page's number as a second key.
SALTS = 32
MAX_BROADCAST_ROWS = 500_000
EPOCH = 1577836800
NL = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base-32 digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query without fragment: com,example)/path."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]|#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?@]*@)?(?:www\d*\.)?([^/?:]*)", 1))
    path = F.regexp_replace(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", "")
    return F.when(plain == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, bytes, digest, refers_to (null for responses)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.select("*", F.octet_length("html").alias("bytes"), base32_sha1(F.col("html").cast("binary")).alias("digest"))
    groups = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null").select("digest", "first")
    groups = materialize(groups, "equal-payloads")
    if groups.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        joined = rows.join(F.broadcast(groups), "digest", "left")
    else:  # the key of a payload that very many pages share is split
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    again = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return joined.select("page_id", "url", "html", "bytes", "digest", F.when(F.col("first").isNotNull() & again & (F.col("bytes") >= min_bytes), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    rows = with_revisits(pages, min_bytes)
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    time = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0)))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.col("bytes").cast("string"), F.lit(NL + NL))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit(f"WARC/1.1{NL}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{NL}WARC-Record-ID: "), name("page_id"), F.lit(f"{NL}WARC-Target-URI: "), uri,
        F.lit(f"{NL}WARC-Date: "), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f"{NL}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{NL}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{NL}WARC-Refers-To: "), name("refers_to"))).otherwise(""),
        F.lit(f"{NL}Content-Type: application/http; msgtype=response{NL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(NL + NL), block)
    sorted_ = rows.select(record.alias("value"), url_key(F.col("url")).alias("key"), time.alias("time"), "page_id").sortWithinPartitions("key", "time", "page_id").select("value")

    def files(batches):
        held, size = [], 0
        for batch in lean(batches):
            for value in batch.column(0):
                data = value.as_buffer().to_pybytes()
                if held and size + len(data) > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], names=["file"])
                    held, size = [], 0
                held.append(data)
                size += len(data)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], names=["file"])

    ship(pages.sparkSession)
    made = sorted_.mapInArrow(files, "file binary").select(F.col("file").cast("string").alias("value"))
    made.write.option("lineSep", NL + NL).option("maxRecordsPerFile", 1).text(path)


def records(data: bytes):
    """(offset, length, headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(NL)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end at byte {stop}")
        yield at, stop + 4 - at, headers, data[end + 4 : stop]
        at = stop + 4


CAPTURE = "url string, time string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long, run string"


def _page(name: str | None) -> int | None:
    found = name[len("<urn:page:") : -1] if name else "null"
    return None if found == "null" else int(found)


def read(spark, path: str) -> DataFrame:
    """One row per record; the payload of a revisit is described by the HTTP header that it kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        for batch in lean(batches):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for offset, length, h, block in records(data.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = h["WARC-Type"]
                    n = len(payload) if kind == "response" else int(head.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Payload-Digest"] != f"sha1:{digest}":
                        raise ValueError(f"payload of {name} at byte {offset} has another digest")
                    out.append((h["WARC-Target-URI"], h["WARC-Date"], _page(h["WARC-Record-ID"]), kind, _page(h.get("WARC-Refers-To")), n, digest, offset, length, name.rpartition("/")[2]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[x.split()[0] for x in CAPTURE.split(", ")])

    return files.mapInArrow(run, CAPTURE)


class LoserTree:
    """k-way merge of sorted iterators of (key, value): inner nodes keep losers, so each output costs one path of compares."""

    def __init__(self, runs: list) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k:
            winner = self.losers[0]
            if self.heads[winner] is None:
                return
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def _key(text: str | None) -> bytes:
    return (text or "").encode()


def capture_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures in global order of (url_key, time, page_id, run, offset) over the partitions of the result, merged from the sorted runs."""
    keyed = captures.withColumn("url_key", url_key(F.col("url")))
    ranges = max(1, -(-captures.count() // range_rows))
    # within a range each run is brought back to the order of its file; the runs themselves are merged below
    dealt = keyed.repartitionByRange(ranges, "url_key", "time", "page_id", "run", "offset").sortWithinPartitions("run", "offset")
    at = {c: i for i, c in enumerate(dealt.columns)}

    def run(batches):
        rows = list(batches)
        if not rows:
            return
        whole = pa.Table.from_batches(rows)
        keys = zip(*(whole.column(at[c]).to_pylist() for c in ("url_key", "time", "page_id", "run")), strict=True)
        runs: dict[str, list] = {}
        for i, (key, time, page, name) in enumerate(keys):
            entry = (_key(key), time, page is not None, page or 0)
            ahead = runs.setdefault(name, [])
            if ahead and ahead[-1][0] > entry:
                raise ValueError(f"run {name} is not in order at {key}")
            ahead.append((entry, i))
        order = [i for _, i in LoserTree([runs[name] for name in sorted(runs)])]
        yield from whole.take(pa.array(order)).combine_chunks().to_batches()

    return dealt.mapInArrow(run, dealt.schema)


def archive(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as archives to path, read them back and give the merged capture index; without a path the archives go once read."""
    target = path or fresh_path(pages.sparkSession, "warc")
    write(pages, target, min_bytes)
    captures = materialize(read(pages.sparkSession, target), "captures")
    if path is None:
        drop_path(pages.sparkSession, target)
    return capture_index(captures)


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The whole result; five hex digits of a digest are four base-32 digits.
ORACLE = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM payloads),
groups AS (
  SELECT page_id, payload_bytes, first, list_transform(range(8), lambda i: list_sum(list_transform(range(5), lambda j: (instr('0123456789abcdef', substr(hex, 5 * i + j + 1, 1)) - 1) << (4 * (4 - j))))::BIGINT) AS g FROM hashed)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(g, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('{_DIGITS}', ((v >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM groups
"""
