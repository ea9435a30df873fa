"""Web archives with a merged capture index.

Tasks write captures as WARC records, one gzip member each, to files in shared storage.
When a file is closed, its captures form a run sorted by URL key and timestamp. Ranges
of that order then gather their slices of all runs, and each range merges its slices by
a loser tree: the ranges in turn are the globally ordered capture histories.

A payload that an earlier capture already has isn't stored again: a revisit record
refers to the response that holds it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriba.llm.common import materialise, scratch_dir

#: A file is closed when it has so many bytes or records.
FILE_BYTES, FILE_RECORDS = 256 << 20, 50_000
#: Payloads under so many bytes are stored every time.
REVISIT_BYTES = 100
LEVEL = 4
#: Captures that one range of the index merges, about; the number of ranges grows with the index.
RANGE_RECORDS = 100_000
#: Repeated payloads up to so many reach all tasks, so that no payload is shuffled; more are joined by digest.
BROADCAST_DIGESTS = 200_000
_CHUNK = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """The URL as a sort key: host labels reversed, then path and query; without scheme, user, port, ``www.`` and fragment."""
    host = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(host), r"^.*@|:\d*$", "")
    host = F.regexp_replace(host, r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", ""), "#.*$", "")
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


# --------------------------------------------------------------------------
# records
# --------------------------------------------------------------------------


def _header(value: object) -> str:
    """A value that keeps to its header line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in str(value))


def record(page_id: int | None, url: str | None, seconds: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Date: {datetime.fromtimestamp(seconds, UTC):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC headers, the HTTP headers and the payload of a record; header names are lower-case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def members(source) -> Iterator[tuple[int, bytes]]:
    """``(offset, content)`` of each gzip member of a stream, one at a time."""
    at, data = 0, source.read(_CHUNK)
    while data:
        start, out, unzip = at, [], zlib.decompressobj(31)
        while not unzip.eof:
            if not data:
                raise EOFError(f"the archive ends inside the record at {start}")
            out.append(unzip.decompress(data))
            at += len(data) - len(unzip.unused_data)
            data = unzip.unused_data or (b"" if unzip.eof else source.read(_CHUNK))
        yield start, b"".join(out)
        data = data or source.read(_CHUNK)


# --------------------------------------------------------------------------
# writing
# --------------------------------------------------------------------------

_INDEX = "url_key string, seconds long, page_id long, file string, offset long, length long"
_INDEX_ARROW = pa.schema([("url_key", pa.string()), ("seconds", pa.int64()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Write ``captures (page_id, url, url_key, seconds, payload, digest, refers_to)``; gives the index, a sorted run for each file.

    File names hold a fresh id for each attempt of a task. Only files in the index
    count, so that a task that is lost or runs twice does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part, out, index, at = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, at = f"{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = record(r["page_id"], r["url"], r["seconds"], r["payload"], r["digest"], r["refers_to"])
                member = zipper.compress(raw) + zipper.flush()
                out.write(member)
                index.append({"url_key": r["url_key"], "seconds": r["seconds"], "page_id": r["page_id"], "file": name, "offset": at, "length": len(member)})
                at += len(member)
                if at >= FILE_BYTES or len(index) >= FILE_RECORDS:
                    out.close()
                    out, done, index = None, index, []
                    yield _run(done)
        if out is not None:
            out.close()
            yield _run(index)

    return materialise(captures.select("page_id", "url", "url_key", "seconds", "payload", "digest", "refers_to").mapInArrow(run, _INDEX), "runs")


def _run(index: list[dict]) -> pa.RecordBatch:
    index.sort(key=lambda x: (x["url_key"].encode(), x["seconds"], -1 if x["page_id"] is None else x["page_id"], x["offset"]))
    return pa.RecordBatch.from_pylist(index, schema=_INDEX_ARROW)


# --------------------------------------------------------------------------
# merging
# --------------------------------------------------------------------------


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so the next winner takes one match a level."""

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _head(self, i: int) -> tuple:
        """The run's next key; a run that is at its end loses to all others."""
        if i < len(self.runs) and self.at[i] < len(self.runs[i]):
            return (0, self.runs[i][self.at[i]], i)
        return (1, i)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # still to be played from the other side
                self.tree[node] = i
                return
            if self.heads[self.tree[node]] < self.heads[i]:
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while True:
            i = self.tree[0]
            if self.heads[i][0]:
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            self._play_again(i)

    def _play_again(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.heads[self.tree[node]] < self.heads[i]:
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a range's slices of runs, which come one after the other, each in order. A range has about RANGE_RECORDS captures."""
    runs: dict[str, list] = {}
    for batch in batches:
        for key, seconds, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(file, []).append((key.encode(), seconds, -1 if page is None else page, file, offset, length))
    part, rows = TaskContext.get().partitionId(), []
    schema = _INDEX_ARROW.append(pa.field("index_part", pa.int32())).append(pa.field("index_pos", pa.int64()))
    for n, (key, seconds, page, file, offset, length) in enumerate(LoserTree(list(runs.values()))):
        rows.append({"url_key": key.decode(), "seconds": seconds, "page_id": None if page == -1 else page, "file": file, "offset": offset, "length": length, "index_part": part, "index_pos": n})
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The index with ``position``: its place in the order of URL key, timestamp and page, from 0.

    Ranges of that order, as many as the index is long, bound what a task holds, also for
    a URL with very many captures. An empty index gives an empty one.
    """
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_RECORDS))
    ranges = runs.repartitionByRange(parts, "url_key", "seconds", F.coalesce("page_id", F.lit(-1)), "file", "offset")
    ordered = ranges.sortWithinPartitions("file", "url_key", "seconds", F.coalesce("page_id", F.lit(-1)), "offset").select("url_key", "seconds", "page_id", "file", "offset", "length")
    merged = materialise(ordered.mapInArrow(_merge, f"{_INDEX}, index_part int, index_pos long"), "merged")
    counts = merged.groupBy("index_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    upto = Window.orderBy("index_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("index_part").alias("part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    placed = merged.join(counts, merged["index_part"] == counts["part"])
    return placed.withColumn("position", F.col("before") + F.col("index_pos")).drop("part", "before", "index_part", "index_pos")


# --------------------------------------------------------------------------
# reading
# --------------------------------------------------------------------------

_READ = "file string, offset long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of ``files (file)``. A revisit has its payload's digest and length, not the payload itself.

    A response's digest and length are those of what was read. Each file is a task's own:
    the list of names is dealt out one by one, in as many partitions as there are files.
    """
    def page(value: str | None) -> int | None:
        tail = (value or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for offset, raw in members(source):
                        warc, http, payload = parse_record(raw)
                        again = warc["warc-type"] == "revisit"
                        digest = warc["warc-payload-digest"].removeprefix("sha256:") if again else hashlib.sha256(payload).hexdigest()
                        n = int(http["content-length"]) if again else len(payload)
                        rows.append((name, offset, page(warc["warc-record-id"]), warc["warc-target-uri"], warc["warc-type"], digest, n, page(warc.get("warc-refers-to")), payload if payloads and not again else None))
                        size += len(payload) if payloads else 0
                        if len(rows) >= 1000 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = materialise(files.select("file").distinct(), "files")
    return names.coalesce(1).repartition(max(1, names.count())).mapInArrow(run, _READ)


def captures_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seconds_col: str | None = None) -> DataFrame:
    """Captures with their URL key, digest and the page that a revisit refers to.

    Without a column of capture times (seconds since 1970), a page's id stands in for it.
    Payloads stay where they were read while the repeated ones are BROADCAST_DIGESTS or
    fewer; beyond that they are shuffled by digest, and a frequent one is a skewed join.
    """
    seconds = F.col(seconds_col).cast("long") if seconds_col else F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(4_000_000_000))
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), url_key(F.col(url_col).cast("string")).alias("url_key"), seconds.alias("seconds"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    first = materialise(first, "repeated")
    if first.count() <= BROADCAST_DIGESTS:
        first = F.broadcast(first)
    return rows.join(first, "digest", "left").withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first"))).drop("first")


def archive(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write all pages to archives and read them back, in the order of the merged index.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to, url_key,
    position)`` for every row. A null html is an empty payload, a null URL
    an empty one. Of equal payloads of 100 bytes and more the smallest page_id is the
    response; rows that repeat that page_id are responses too, and those of null id
    revisit it, or are responses where no row has an id. Payloads are written and read
    whole, however long. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    runs = write_archives(captures_of(pages, **columns), folder)
    merged = merge_runs(runs).select("file", "offset", "url_key", "position")
    records = read_archives(runs, folder, payloads=False).drop("payload")
    return records.join(merged.hint("merge"), ["file", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")



ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, url,
         regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^.*@|:[0-9]*$', '', 'g'), '^www[0-9]*[.]', '') AS host,
         regexp_replace(regexp_replace(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*', ''), '#.*$', '') AS rest
  FROM pages),
k AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest,
             coalesce(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END, '') AS url_key FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM k)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, url_key,
       (row_number() OVER (ORDER BY url_key, page_id % 4000000000, page_id) - 1)::BIGINT AS "position"
FROM f
"""
