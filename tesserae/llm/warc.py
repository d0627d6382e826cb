"""WARC archives with a two-level capture index.

write() stores each page as a record of its own gzip member, in files of up to SEGMENT bytes, so that every record
can be read by its range. Of records with equal payloads of at least LEAST bytes, that with the smallest page_id is
the response, and the others are revisits that refer to it.

The index sorts captures by a key of reversed host, rest of the URL and page_id. Its lines are cut into blocks of
LINES, which are compressed one by one and laid into index files, one for each range of keys. The directory, the
sparse upper level, has a row for each block: its first and last key and its range in the index file.

find() takes requests (url, page_id) by bisection to the index file they lie in. There the file's directory rows and the
requests pass in the order of keys, so that a task holds but the blocks at the current key, reads a block's range
when a request falls in it, and searches its lines by bisection for the captures. read() reads the records of
captures by their ranges, in the order they have in a file.

Each file starts with a warcinfo record. A record's id is a digest of its file and offset, so that no two share one; the
page_id stands in a field of its own, and revisits name the response by its URL and page_id.

All files lie in the folder given, which must be shared and one that pyarrow's file systems open (local or mounted
folders, S3, GCS, HDFS with its library). A file's name is new for each attempt of a task, and only captures that a
finished attempt reported are indexed, so lost executors leave unused files at worst.

Defined results: null html is an empty payload, which is a response of 0 bytes; a null url has the empty key; null
page_ids are stored and read back as null, and count as greater than all others among equal payloads; rows that
repeat url and page_id each are stored and read. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import new_path, ship, written

LEAST = 100
SEGMENT = 1 << 29
LINES = 1000
READ = 1 << 23
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id bigint, file string, offset bigint, length bigint"


def opened(uri: str, write: bool = False):  # noqa: ANN201
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if not write:
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def key_of(url: str | None, page_id: int | None) -> str:
    """Reversed host in lower case, the rest of the URL, and page_id in a form that sorts."""
    rest = (url or "").partition("://")[2] or (url or "")
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    return f"{','.join(reversed(host.lower().split('.')))}){tail} {'' if page_id is None else f'{page_id + 2**63:020d}'}"


def _member(head: list[str], body: bytes, place: str) -> bytes:
    """A record as a gzip member; place: where it lies, which its id comes from."""
    head = ["WARC/1.1", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Date: {DATE}", *head, f"Content-Length: {len(body)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def _uri(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def info(place: str) -> bytes:
    return _member(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n", place)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None, place: str) -> bytes:
    """One record as a gzip member; first, first_url: the response that it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if first is None else http
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first is not None:
        head += [f"WARC-Refers-To-Target-URI: {_uri(first_url)}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Refers-To-Page-ID: {first}", f"WARC-Profile: {PROFILE}"]
    return _member([*head, "Content-Type: application/http; msgtype=response"], body, place)


def parsed(member: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (None for a revisit) of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where it should")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda s: int(s) if s else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't have its digest")
    return {"page_id": number(fields["WARC-Page-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To-Page-ID"]) if revisit else None, "payload": None if revisit else payload}


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and gives their captures (key, page_id, file, offset, length) as a table in the shared folder."""
    import pyarrow as pa

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= LEAST
    # short payloads have keys of their own, so that they aren't dealt to one task
    same = rows.filter(long).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1 and f is not null").select(F.col("digest").alias("d"), F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"))
    same = written(same, "same")  # a table, so that Spark can split the many rows of one payload in the join
    own = F.when(long, F.col("digest")).otherwise(F.concat(F.lit("short "), F.xxhash64("page_id", "url").cast("string")))
    dealt = rows.withColumn("own", own).join(same, F.col("own") == F.col("d"), "left")
    dealt = dealt.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, at = None, "", 0
        try:
            for b in batches:
                keys, ids, files, offsets, lengths = [], [], [], [], []
                for page_id, url, html, digest, first, first_url in zip(*b.columns, strict=True):
                    if out is None or at > SEGMENT:
                        if out is not None:
                            out.close()
                        file, at = f"{folder}/archive/{uuid.uuid4().hex}.warc.gz", 0
                        out = opened(file, write=True)
                        head = info(file)
                        out.write(head)
                        at = len(head)
                    page_id, url = page_id.as_py(), url.as_py()
                    member = record(page_id, url, html.as_py().encode(), digest.as_py(), first.as_py(), first_url.as_py(), f"{file}#{at}")
                    out.write(member)
                    for column, x in zip((keys, ids, files, offsets, lengths), (key_of(url, page_id), page_id, file, at, len(member)), strict=True):
                        column.append(x)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return written(dealt.mapInArrow(run, CAPTURE), "captures")


def index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Writes the index files and gives the directory (part, first, last, file, offset, length) as a table in the shared folder."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        file, at, out = f"{folder}/index/{part:06d}-{uuid.uuid4().hex}.cdx", 0, None
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal at, out
            if out is None:
                out = opened(file, write=True)
            data = zlib.compress("\n".join("\t".join(map(str, c)) for c in held).encode())
            out.write(data)
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, held[0][0], held[-1][0], file, at, len(data))], names=["part", "first", "last", "file", "offset", "length"])
            at += len(data)
            held.clear()
            return row

        try:
            for b in batches:
                for key, page_id, f, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append((_line(key), "" if page_id is None else page_id, f, offset, length))
                    if len(held) == lines:
                        yield block()
            if held:
                yield block()
        finally:
            if out is not None:
                out.close()

    ranged = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key")
    return written(ranged.mapInArrow(run, "part bigint, first string, last string, file string, offset bigint, length bigint"), "directory")


def _line(key: str) -> str:
    """A key as it stands in an index line, in which tabs and line ends part fields."""
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def find(directory: DataFrame, requests: DataFrame) -> DataFrame:
    """The captures of requests (url, page_id), each capture once."""
    import pyarrow as pa

    # one row for each index file, of which there are as many as partitions
    bounds = sorted((r["lo"], r["hi"], r["part"]) for r in directory.groupBy("part").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).toLocalIterator())
    lows = [b[0] for b in bounds]
    highs = [b[1] for b in bounds]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, parts = [], []
            for url, page_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = _line(key_of(url, page_id))
                for i in range(bisect_left(highs, key), bisect_right(lows, key)):  # one, or more where equal keys were cut apart
                    keys.append(key)
                    parts.append(bounds[i][2])
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(keys, pa.string())], names=["part", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))
        part, key, found = None, None, []
        held: list[list] = []  # the blocks at the current key: last key, file, offset, length, lines and their keys once read
        name, f = "", None
        try:
            for b in batches:
                out: list[tuple] = []
                for p, k, last, file, offset, length in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if p != part:
                        part, key = p, None
                        held.clear()
                    if last is not None:
                        held.append([last, file, offset, length, None, None])
                        continue
                    if k == key:  # asked for more than once: each capture once
                        continue
                    key = k
                    while held and held[0][0] < k:
                        held.pop(0)
                    for block in held:
                        if block[4] is None:
                            if block[1] != name:
                                if f is not None:
                                    f.close()
                                name, f = block[1], opened(block[1])
                            block[4] = [x.split("\t") for x in zlib.decompress(f.read_at(block[3], block[2])).decode().split("\n")]
                            block[5] = [x[0] for x in block[4]]
                        found = block[4][bisect_left(block[5], k) : bisect_right(block[5], k)]
                        out += [(k, int(x[1]) if x[1] else None, x[2], int(x[3]), int(x[4])) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])
        finally:
            if f is not None:
                f.close()

    routed = requests.select("url", F.col("page_id").cast("bigint")).mapInArrow(route, "part bigint, key string")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("last", "string"), ("file", "string"), ("offset", "bigint"), ("length", "bigint"))]
    both = directory.select("part", F.col("first").alias("key"), "last", "file", "offset", "length").unionAll(routed.select("part", "key", *none))
    # a task for each part; in each the blocks of a key come before the requests for it
    ordered = both.repartition(max(1, len(bounds)), "part").sortWithinPartitions("part", "key", F.col("last").isNull(), "offset")
    return ordered.mapInArrow(search, CAPTURE)


def read(captures: DataFrame, payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits) of each capture's record, verified."""
    import pyarrow as pa

    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = "", None
        try:
            for b in batches:
                spans = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
                for lo in range(0, len(spans), 200):
                    found = []
                    for file, offset, length in spans[lo : lo + 200]:
                        if file != name:
                            if f is not None:
                                f.close()
                            name, f = file, opened(file)
                        found.append(parsed(f.read_at(length, offset)))
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in kinds], names=[n for n, _ in kinds])
        finally:
            if f is not None:
                f.close()

    ship(captures.sparkSession)
    placed = captures.select("file", "offset", "length", (F.col("offset") / READ).cast("bigint").alias("piece"))
    return placed.repartition("file", "piece").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, schema)


def lookup(directory: DataFrame, urls: list[tuple[str, int]]) -> DataFrame:
    """The records of a few (url, page_id), with payloads."""
    return read(find(directory, directory.sparkSession.createDataFrame(urls, "url string, page_id bigint")), payload=True)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages, indexes them, and reads all of them back by way of the index."""
    folder = new_path(spark, "warc")
    directory = index(write(pages, folder), folder)
    return read(find(directory, pages.select("url", "page_id")))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
