"""WARC archives with a two-level capture index.

Each record is a gzip member of its own.  Spark's text writer puts them into
files, an empty gzip member taking the place of the line end, so an archive is
committed like any other Spark output, on any file system Spark can reach, and
is a valid ``.warc.gz`` stream (whatever the file's name).

The index has a line for each capture, sorted by reversed-host URL key.  Lines
are compressed in blocks; a sparse directory holds each block's first and last
key, file, offset and length.  A lookup searches the directory by halving, reads
the range of one block (or of a few, if a key's captures cross them), searches
that, and reads the range of the record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_key, new_path, utf8, written

#: Lines in a block of the index.
BLOCK_LINES = 3000
#: Entries of a directory that a lookup of many URLs sends to every task.
MOST_ENTRIES = 200_000
#: Ranges that a longer directory is cut into.
MOST_RANGES = 4096
_EMPTY = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")
_EMPTY_LINE = _EMPTY.decode("latin-1")
_PIECE = 1 << 16


def header_url(url: str) -> str:
    """A URL as a record's header can hold it: on one line."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def url_key(url: str | None) -> str:
    """The URL with its host reversed, lower-cased and without port 80 or 443, fragment and leading www.

    The key is that of the URL as it is written, so what is looked up and what was indexed agree.
    """
    if not url:
        return "-"
    url = header_url(url)
    try:
        parts = urlsplit(url if "//" in url else "http://" + url)
    except ValueError:  # no URL: its own text is the key
        return url
    try:
        port = parts.port
    except ValueError:
        port = None
    host = (parts.hostname or "").rstrip(".")
    host = host[4:] if host.startswith("www.") else host
    key = ",".join(reversed(host.split("."))) + ("" if port in (None, 80, 443) else f":{port}")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response record, or a revisit record without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: "<urn:page:" + ("none" if i is None else str(i)) + ">"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + header_url(url))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; for a response also its payload, whose digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda v: None if v is None or v == "<urn:page:none>" else int(v[10:-1])
    out = {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "date": fields["WARC-Date"], "type": fields["WARC-Type"], "digest": digest, "size": size, "refers_to": page(fields.get("WARC-Refers-To"))}
    if out["type"] == "response":
        if len(payload) != size or digest_of(payload) != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        out["payload"] = payload
    return out


def _members(pieces: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members, in a stream of pieces, that hold something; a piece and a record are in memory."""
    d, parts, start, read = zlib.decompressobj(31), [], 0, 0
    for piece in pieces:
        read += len(piece)
        while piece:
            parts.append(d.decompress(piece))
            piece = b""
            if d.eof:
                piece = d.unused_data
                end, content = read - len(piece), b"".join(parts)
                if content:
                    yield start, end - start, content
                d, parts, start = zlib.decompressobj(31), [], end
    if start != read:
        raise ValueError("a member is cut off")


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """The members of an archive that is in memory."""
    return _members(raw[a : a + _PIECE] for a in range(0, len(raw), _PIECE))


def _opened(uri: str):
    """A file of any store that Arrow reaches, open for ranges."""
    if uri.startswith("file:"):  # as Spark writes it, not quoted
        return LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    store, path = FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _streamed(uri: str) -> Iterator[tuple[int, int, bytes]]:
    with _opened(uri) as f:
        yield from _members(iter(lambda: f.read(_PIECE), b""))


def read_range(uri: str, offset: int, length: int) -> bytes:
    """A range of a file; nothing else of it is read."""
    with _opened(uri) as f:
        return f.read_at(length, offset)


def _save(members_: DataFrame, path: str) -> None:
    """A column of gzip members to files, each followed by an empty member."""
    members_.select(F.col("member").cast("string").alias("value")).write.option("lineSep", _EMPTY_LINE).option("encoding", "ISO-8859-1").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of the files in a folder, one to a task as far as there are tasks; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").repartition("path")


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, payload sha256, refers_to)`` of pages whose payload, of ``least`` bytes or more, another page has too.

    The largest page_id of those is what the others refer to.
    """
    keys = pages.select(F.col("page_id"), F.sha2(utf8(F.col("html")), 256).alias("sha"), F.octet_length(utf8(F.col("html"))).alias("n")).where(F.col("n") >= least)
    keys = written(keys, "payloads")
    groups = written(keys.groupBy("sha").agg(F.max(id_key(F.col("page_id"))).alias("last"), F.count("*").alias("times")).where("times > 1").select(F.col("sha").alias("_sha"), "last"), "equal")
    out = keys.join(groups, F.col("sha") == F.col("_sha")).where(id_key(F.col("page_id")) != F.col("last"))
    return out.select(id_key(F.col("page_id")).alias("_id"), F.col("sha").alias("_sha"), F.col("last").alias("refers_to")).distinct()


def write(pages: DataFrame, path: str, least: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """A record for every row of ``pages(page_id, url, html)``, as archives in the new folder ``path``.

    Payload is the html in UTF-8; null counts as empty.  Of equal payloads of
    ``least`` bytes or more the largest page_id's is written as response (all
    rows that repeat it), the others as revisits; a null page_id counts as the
    smallest.  A null url leaves the target out.  Other columns are ignored; an
    empty table gives archives without records.
    """
    again = written(revisits(pages, least), "revisits")
    rows = pages.select("page_id", "url", utf8(F.col("html")).alias("raw"), F.sha2(utf8(F.col("html")), 256).alias("sha"))
    rows = rows.join(again, (id_key(F.col("page_id")) == F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "raw", "refers_to", F.col("_id").isNotNull().alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows_ = zip(*(part.column(i) for i in range(5)))
                out = [gzip.compress(record(i.as_py(), u.as_py(), raw.as_py(), to.as_py(), a.as_py(), date), 6, mtime=0) for i, u, raw, to, a in rows_]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    _save(rows.mapInArrow(run, "member binary"), path)


_CAPTURE = "key string, date string, page_id long, url string, file string, offset long, length long, type string, digest string, size long, refers_to long"
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]


def captures(spark: SparkSession, path: str) -> DataFrame:
    """What the archives in ``path`` hold, read back record by record; damaged records raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                cols: list[list] = [[] for _ in _NAMES]
                for offset, length, raw in _streamed(name):
                    r = parse(raw)
                    for c, v in zip(cols, (url_key(r["url"]), r["date"], r["page_id"], r["url"], name, offset, length, r["type"], r["digest"], r["size"], r["refers_to"])):
                        c.append(v)
                    if len(cols[0]) >= BLOCK_LINES:
                        yield pa.RecordBatch.from_pydict(dict(zip(_NAMES, cols)), schema=_schema())
                        cols = [[] for _ in _NAMES]
                yield pa.RecordBatch.from_pydict(dict(zip(_NAMES, cols)), schema=_schema())

    return _files(spark, path).mapInArrow(run, _CAPTURE)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _CAPTURE.split(", ")])


def build_index(spark: SparkSession, path: str, index: str, block_lines: int = BLOCK_LINES) -> None:
    """Index the archives in ``path`` into the new folder ``index``: ``blocks`` and ``directory``."""
    lines = captures(spark, path).repartitionByRange("key", "date", "page_id").sortWithinPartitions("key", "date", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([gzip.compress(b"".join(held), 6, mtime=0)], pa.binary())], ["member"])

        for batch in batches:
            for row in batch.to_pylist():
                key, date = row.pop("key"), row.pop("date")
                held.append(json.dumps([key, date, row]).encode() + b"\n")
                if len(held) >= block_lines:
                    yield flush()
                    held = []
        if held:
            yield flush()

    _save(lines.mapInArrow(run, "member binary"), f"{index}/blocks")

    kinds = {"first": pa.string(), "last": pa.string(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "lines": pa.int64()}

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                for offset, length, raw in _streamed(name):
                    rows = raw.splitlines()
                    out.append({"first": json.loads(rows[0])[0], "last": json.loads(rows[-1])[0], "file": name, "offset": offset, "length": length, "lines": len(rows)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(kinds.items())))

    directory = _files(spark, f"{index}/blocks").mapInArrow(entries, "first string, last string, file string, offset long, length long, lines long")
    directory.write.parquet(f"{index}/directory")


def _block_lines(raw: bytes) -> list[list]:
    return [json.loads(x) for x in raw.splitlines()]


class Index:
    """Lookups of single URLs; holds the sparse directory (refused above MOST_ENTRIES entries)."""

    def __init__(self, spark: SparkSession, index: str):
        self.spark = spark
        rows = spark.read.parquet(f"{index}/directory")
        n = rows.count()
        if n > MOST_ENTRIES:
            raise ValueError(f"the directory has {n} entries; look up many URLs at once with lookup()")
        self.entries = sorted((tuple(r) for r in rows.select("first", "last", "file", "offset", "length").collect()))
        self.firsts = [e[0] for e in self.entries]

    def captures(self, url: str) -> list[dict]:
        key, out = url_key(url), []
        at = bisect_right(self.firsts, key) - 1
        while at > 0 and self.entries[at - 1][1] >= key:
            at -= 1
        for first, last, file, offset, length in self.entries[max(at, 0) :]:
            if first > key:
                break
            if last >= key:
                rows = _block_lines(gzip.decompress(read_range(file, offset, length)))
                keys = [r[0] for r in rows]
                out += [{"key": k, "date": d, **x} for k, d, x in rows[bisect_left(keys, key) : bisect_right(keys, key)]]
        return out

    def record(self, capture: dict) -> dict:
        return parse(gzip.decompress(read_range(capture["file"], capture["offset"], capture["length"])))


def _met(wanted: DataFrame, directory: DataFrame, ranges: int = MOST_RANGES) -> DataFrame:
    """``(key, file, offset, length)``: the entries that may hold each key, by a merge of both in order.

    ``ranges`` keys at most, where evenly large parts of the directory begin, are sent to every task.
    """
    dealt = directory.select("first").repartitionByRange(ranges, "first").groupBy(F.spark_partition_id()).agg(F.min("first").alias("first"))
    cuts = sorted(r.first for r in dealt.collect())[1:]
    bucket = lambda x: bisect_right(cuts, x)
    schema = "bucket int, key string, is_key int, last string, file string, offset long, length long"
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([(bucket(k), k, 1, None, None, None, None) for k in batch.column(0).to_pylist()])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([(b, first, 0, last, *at) for first, last, *at in zip(*(c.to_pylist() for c in batch.columns)) for b in range(bucket(first), bucket(last) + 1)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for batch in batches:
            out = []
            for b, key, is_key, last, *at in zip(*(c.to_pylist() for c in batch.columns)):
                if b != now:
                    now, open_ = b, []
                open_ = [e for e in open_ if e[0] >= key]
                if is_key:
                    out += [(key, *e[1:]) for e in open_]
                else:
                    open_.append((last, *at))
            cols = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])

    both = wanted.mapInArrow(keys, schema).unionByName(directory.select("first", "last", "file", "offset", "length").mapInArrow(entries, schema))
    return both.repartition("bucket").sortWithinPartitions("bucket", "key", "is_key").mapInArrow(merge, "key string, file string, offset long, length long")


def lookup(spark: SparkSession, index: str, urls: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Captures of many URLs (a column ``url``).

    Each key's blocks are found by halving in the sparse directory, of which
    every task holds a copy while it has ``most_entries`` entries at most; beyond
    that keys and entries are dealt by ranges and merged in order.  A block's range is read once, whatever
    the number of its keys, and searched by halving for each.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({url_key(u) for u in batch.column(0).to_pylist()}), pa.string())], ["key"])

    wanted = urls.select("url").mapInArrow(keys, "key string").distinct()
    directory = spark.read.parquet(f"{index}/directory").select("first", "last", "file", "offset", "length")
    if directory.count() <= most_entries:
        entries = sorted(tuple(r) for r in directory.collect())  # most_entries at most
        held = spark.sparkContext.broadcast((entries, [e[0] for e in entries]))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries, firsts = held.value
            for batch in batches:
                out = []
                for key in batch.column(0).to_pylist():
                    at = bisect_right(firsts, key) - 1
                    while at >= 0 and entries[at][1] >= key:
                        out.append((key, *entries[at][2:]))
                        at -= 1
                cols = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])

        found = wanted.mapInArrow(blocks, "key string, file string, offset long, length long")
    else:
        found = _met(wanted, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, names = None, [], []
        for batch in batches:
            out = []
            for key, *at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != last:
                    last, rows = at, _block_lines(gzip.decompress(read_range(*at)))
                    names = [r[0] for r in rows]
                for a in range(bisect_left(names, key), bisect_right(names, key)):
                    out.append({"key": rows[a][0], "date": rows[a][1], **rows[a][2]})
                    if len(out) == 5000:  # many captures may share a key
                        yield pa.RecordBatch.from_pylist(out, schema=_schema())
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema=_schema())

    return found.repartition("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, _CAPTURE)


def read_records(found: DataFrame) -> DataFrame:
    """``(page_id, url, date, type, digest, size, refers_to, payload)`` of captures, each record read by its range and checked."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "date": pa.string(), "type": pa.string(), "digest": pa.string(), "size": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        try:
            for batch in batches:
                out, held = [], 0
                for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = file, _opened(file)
                    r = parse(gzip.decompress(f.read_at(length, offset)))
                    out.append({k: r.get(k) for k in kinds})
                    held += r["size"]
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(kinds.items())))
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(kinds.items())))
        finally:
            if f is not None:
                f.close()

    # ranges of a file that are near each other are read by one task, one after the other
    spread = found.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(run, "page_id long, url string, date string, type string, digest string, size long, refers_to long, payload binary")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` written as archives in the shared folder and indexed; then each page's URL is looked up and its records are read back.

    Nulls, malformed URLs, repeated rows and empty tables are as in ``write``; a
    payload of any length is a record of its own.  As many records come back as pages went in, or an error is raised.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, f"{path}/archives", least)
    build_index(spark, f"{path}/archives", f"{path}/index")
    found = written(lookup(spark, f"{path}/index", pages), "captures")
    there, back = pages.count(), found.count()
    if there != back:
        raise ValueError(f"{there} pages were written, and the index finds {back} records")
    return read_records(found)
