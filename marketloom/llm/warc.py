"""WARC archives: written, read back, and indexed by an external merge.

Captures are written as WARC/1.1 records by Spark's text writer (gzip, committed like any table), read
back record by record by their Content-Length, and indexed. The index of one archive file, sorted by
URL key and time, is a run. Splitters drawn from a sample of the keys cut every run into ranges; the
pieces of a range meet in one task, where a loser tree merges them without sorting again. The ranges
in order are the capture histories of all URLs in global order.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import stage
from marketloom.session import scratch_path

EPOCH = 1_577_836_800
"""2020-01-01; the capture time of a table without one is this plus its id, in seconds."""

INDEX = (
    "url_key string, ts string, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, intact boolean, file string, offset bigint, length bigint"
)
_S, _L = pa.string(), pa.int64()
_ARROW = (_S, _S, _L, _S, _S, _L, _L, _S, pa.bool_(), _S, _L, _L)
_CRLF = "\r\n"


def digested(pages: DataFrame, *, page_id: str, url: str, html: str, seconds: Column | None) -> DataFrame:
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    when = F.coalesce(F.lit(EPOCH) + F.col(f"`{page_id}`"), F.lit(EPOCH)) if seconds is None else seconds
    return pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col(f"`{url}`"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.date_format(F.timestamp_seconds(when), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        text.alias("html"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.sha1(text).alias("digest"),
        F.sha2(text, 256).alias("same"),
    )


def write(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    seconds: Column | None = None,
    min_revisit: int = 1000,
    per_file: int = 20_000,
) -> str:
    """Writes one record per row and returns the folder.

    Of rows with equal payloads of at least ``min_revisit`` bytes, that with the largest page_id is a
    response and the others are revisits of it (profile identical-payload-digest). Smaller payloads,
    and groups without any page_id, are all responses; rows that repeat the largest page_id are too.
    Null html: empty payload. Null url or page_id: the header is left out. Line breaks in a URL are
    percent-encoded. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = digested(pages, page_id=page_id, url=url, html=html, seconds=seconds)
    # The payload's SHA-256 and length stand for the payload.
    groups = stage(
        rows.where(F.col("bytes") >= min_revisit)
        .groupBy("same", "bytes")
        .agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
        .where("n > 1 AND keep IS NOT NULL")
        .select("same", "bytes", "keep"),
        "warc_groups",
    )
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("bytes"), F.lit(_CRLF * 2),
    )
    block = F.concat(F.col("http"), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))

    def line(name: str, *value: Column | str) -> Column:
        """A header; left out where its value is null."""
        parts = [F.lit(v) if isinstance(v, str) else v for v in value]
        return F.coalesce(F.concat(F.lit(f"{name}: "), *parts, F.lit(_CRLF)), F.lit(""))

    record = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", "<urn:page:", F.col("page_id").cast("string"), ">"),
        line("WARC-Date", F.col("ts")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", "sha1:", F.col("digest")),
        line("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", "<urn:page:", F.when(F.col("revisit"), F.col("keep").cast("string")), ">"),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(_CRLF), F.col("block"), F.lit("\r\n\r"),
    )
    folder = scratch_path(spark, "warc")
    (
        rows.join(groups, ["same", "bytes"], "left")
        .withColumn("revisit", revisit)
        .withColumn("http", http)
        .withColumn("block", block)
        .select(record.alias("value"))
        # The separator of the text writer is the last byte of a record.
        .write.option("lineSep", "\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(folder)
    )
    return folder


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then the rest; hosts and their subdomains are neighbours."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = ",".join(reversed(rest[:cut].lower().split(".")))
    return f"{host}){rest[cut:].partition('#')[0]}"


class _Stream:
    """Bytes of a gzip file, inflated piece by piece."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.inflate = packed, 0, zlib.decompressobj(31)
        self.buffer, self.done = bytearray(), 0

    def _more(self) -> bool:
        if self.at >= len(self.packed):
            return False
        self.buffer += self.inflate.decompress(self.packed[self.at : self.at + 65536])
        self.at += 65536
        if self.inflate.eof and self.inflate.unused_data:
            self.at -= len(self.inflate.unused_data)
            self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends within a record")
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.done += n
        return out


def records(packed: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of a gzip archive."""
    stream = _Stream(packed)
    while True:
        start = stream.done
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        first, *lines = head.decode().split(_CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {start}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}
        block = stream.take(int(headers["content-length"]))
        stream.take(4)
        yield start, stream.done - start, headers, block


def _entry(file: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    def page(name: str) -> int | None:
        return int(headers[name][len("<urn:page:") : -1]) if name in headers else None

    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    intact = revisit or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
    if not revisit:  # what was read counts, not what the header claims
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    url = headers.get("warc-target-uri")
    return (
        url_key(url), headers["warc-date"], page("warc-record-id"), url, headers["warc-type"], page("warc-refers-to"),
        size, digest, intact, file, offset, length,
    )


def _order(e: tuple | list) -> tuple:
    """URL key, time, page_id (null first), then place."""
    return (e[0], e[1], e[2] is not None, e[2] or 0, e[9], e[10])


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of every archive file, as sorted runs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    names = [field.split()[0] for field in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, packed in zip(b.column(0), b.column(1)):
                name = path.as_py().rpartition("/")[2]
                entries = sorted((_entry(name, *r) for r in records(packed.as_py())), key=_order)
                if entries:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*entries), _ARROW)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.mapInArrow(run, INDEX)


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, the winner is on top.

    Taking an element replays one path, log2(k) comparisons.
    """

    def __init__(self, runs: Iterable[Iterable[Any]], key: Callable[[Any], Any]):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.k = max(1, len(self.runs))
        self.heads: list[tuple | None] = [self._pull(i) for i in range(len(self.runs))] or [None]
        self.losers = [0] * self.k
        self.winner = self._play(1)

    def _pull(self, i: int) -> tuple | None:
        for e in self.runs[i]:
            return (self.key(e), e)
        return None

    def _less(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a[0], i) < (b[0], j)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (left, right) if self._less(left, right) else (right, left)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[Any]:
        while (head := self.heads[self.winner]) is not None:
            yield head[1]
            i = self.winner
            self.heads[i] = self._pull(i)
            node = (i + self.k) // 2
            while node:
                if self._less(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merge(index: DataFrame, *, per_range: int = 20_000, max_ranges: int = 25_000, per_splitter: int = 8) -> DataFrame:
    """Merges the runs of an index into global order.

    Adds ``range_no`` (global order is by range, then ``place``), ``place`` within the range and
    ``capture``, the number of the entry within its URL's piece of the range. The driver sees only the
    splitters' sample, about ``per_splitter`` keys for each of at most ``max_ranges`` ranges.
    """
    n = index.count()
    ranges = max(1, min(max_ranges, -(-n // per_range)))
    splitters: list[tuple] = []
    if ranges > 1:
        odds = min(1.0, per_splitter * ranges / n)
        place = F.pmod(F.xxhash64("file", "offset"), F.lit(1 << 40))
        sample = index.where(place < int((1 << 40) * odds))
        keys = sorted(_order(r) for r in sample.select(*index.columns).collect())
        splitters = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    names = index.columns
    entry = F.struct(*names).alias("e")
    piece = f"range_no int, file string, entries array<{index.select(entry).schema['e'].dataType.simpleString()}>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive entries of one file and range become one row."""
        for b in batches:
            out: list[tuple[int, str, list]] = []
            for e in b.column(0).to_pylist():
                r = bisect.bisect_right(splitters, _order(tuple(e.values())))
                if not out or out[-1][:2] != (r, e["file"]):
                    out.append((r, e["file"], []))
                out[-1][2].append(e)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.int32()),
                    pa.array([o[1] for o in out], pa.string()),
                    pa.array([o[2] for o in out], pa.list_(b.column(0).type)),
                ],
                names=["range_no", "file", "entries"],
            )

    schema = f"range_no int, place int, capture int, {INDEX}"

    def play(table: pa.Table) -> pa.Table:
        pieces = [[tuple(e.values()) for e in entries] for entries in table.column("entries").to_pylist()]
        merged = list(LoserTree(pieces, _order))
        capture, last = [], None
        for e in merged:
            capture.append(capture[-1] + 1 if e[0] == last else 1)
            last = e[0]
        kinds = table.schema.field("entries").type.value_type
        columns = [pa.array(c, kinds.field(i).type) for i, c in enumerate(zip(*merged))]
        r = table.column("range_no")[0].as_py()
        return pa.Table.from_arrays(
            [
                pa.array([r] * len(merged), pa.int32()),
                pa.array(range(len(merged)), pa.int32()),
                pa.array(capture, pa.int32()),
                *columns,
            ],
            names=["range_no", "place", "capture", *names],
        )

    return index.select(entry).mapInArrow(cut, piece).groupBy("range_no").applyInArrow(play, schema)


def roundtrip(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives, reads them back and merges their indexes: one row per capture, as ``merge``.

    ``intact`` tells whether a response's payload has the digest and length it was written with.
    Empty table: empty result.
    """
    spark = pages.sparkSession
    runs = read_runs(spark, write(pages, **options))
    return merge(stage(runs, "warc_runs"))
