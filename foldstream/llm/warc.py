"""WARC archives with a two-level capture index.

Tasks write gzip-compressed records one after the other into archive files; of records with equal payloads one carries
the payload and the others refer to it. The capture index has one line per record, keyed by the URL with its host
reversed. Lines are range-sorted by Spark; each task packs its share into compressed blocks of LINES lines in one file, and
leaves a sparse directory with the first key of every block beside it. A lookup takes two binary searches, over the
first keys of the shards and over one shard's directory, then range-reads the blocks that can hold the key, and with
the lines found range-reads the records.

Files go to the shared folder under names of their own per task attempt. A file counts only if a row of the written
index names it, so a task that ran twice, or an executor that was lost, leaves nothing but an unread file.

Defined results: a null html is an empty payload; a null url has the empty key. Repeated rows give a record each; rows
that share the largest page_id of their payload all carry it. Other columns play no part.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstream.llm.common import staged
from foldstream.session import scratch_path

LINES = 1_000
ROWS_AT_ONCE = 50_000
#: A task begins a new archive beyond so many bytes.
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"  # the pages have no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or a plain path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def reversed_url(url: str | None) -> str:
    """Sort key of a URL: com,example,www)/path?query, without scheme, user and port, in lower case up to the path."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records -----------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a WARC/1.1 record; a revisit keeps the HTTP head, so the payload's length is known."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
            ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, headers of its HTTP message, and the bytes after them."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), body


INDEX = "key string, file string, offset long, length long"


def with_referred(pages: DataFrame, least: int = 0) -> DataFrame:
    """Add _largest: the largest page_id with the same payload, null if the payload occurs once or has under `least` bytes."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload).alias("_sha"),
                         F.octet_length(payload).alias("_bytes"))
    often = (keyed.where(F.col("_bytes") >= least).groupBy("_sha").agg(F.count("*").alias("_n"), F.max("page_id").alias("_largest"))
             .where("_n > 1").drop("_n"))
    return keyed.join(often, "_sha", "left").drop("_sha", "_bytes")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for every row (page_id, url, html) below `folder`; gives the capture index, unsorted, staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page in batch.to_pylist():
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    largest = page["_largest"]
                    revisit = largest is not None and page["page_id"] != largest
                    member = record(page["page_id"], page["url"], page["html"].encode(), largest, revisit)
                    out.write(member)
                    rows.append((reversed_url(page["url"]), name, at, len(member)))
                    at += len(member)
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)],
                                      names=["key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return staged(with_referred(pages, least).mapInArrow(run, INDEX), "captures")


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64()]


# --- the index ---------------------------------------------------------------------------------------------------


def write_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Sort the lines by key into compressed blocks below `folder`; gives one row per shard: the first and last key of
    its lines, and the name under which its blocks and its directory lie.

    Lines are ordered by key, file and offset, so one URL with very many captures spreads over shards.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name, blocks, directory, at, held, first, last = uuid.uuid4().hex, None, None, 0, [], None, None

        def pack() -> None:
            nonlocal at
            block = gzip.compress("".join(json.dumps(x) + "\n" for x in held).encode(), 6, mtime=0)
            blocks.write(block)
            directory.write((json.dumps([held[0][0], at, len(block)]) + "\n").encode())
            at += len(block)
            held.clear()

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                if blocks is None:
                    blocks = store.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
                    directory = store.open_output_stream(f"{root}/{name}.dir", compression=None)
                    first = line[0]
                held.append(line)
                last = line[0]
                if len(held) >= lines:
                    pack()
        if blocks is not None:
            if held:
                pack()
            blocks.close()
            directory.close()
            yield pa.record_batch([pa.array([first]), pa.array([last]), pa.array([name])], names=["first", "last", "shard"])

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "file", "offset"]
    sorted_ = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return staged(sorted_.mapInArrow(run, "first string, last string, shard string"), "shards")


def lookup(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """All captures whose key is among `keys` (a column `key`): key, file, offset, length.

    Each key goes to the shards that can hold it, found by binary search over the shards' bounds (a few thousand rows, one
    per index task). There, keys in order share the reading of blocks: the directory is searched, and a block is
    range-read once for all its keys.
    """
    bounds = sorted((r["first"], r["last"], r["shard"]) for r in shards.collect())  # one row per index task
    firsts, lasts, names = ([b[i] for b in bounds] for i in range(3))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, names[at]) for key in batch.column("key").to_pylist()
                     for at in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.record_batch([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        shard, directory, starts, source, block_at, block = None, [], [], None, None, {}
        rows: list[list] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            out = pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)],
                                  names=["key", "file", "offset", "length"])
            rows.clear()
            return out

        for batch in batches:
            for key, name in zip(batch.column("key").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                if name != shard:
                    if source is not None:
                        source.close()
                    shard, block_at = name, None
                    with store.open_input_stream(f"{root}/{name}.dir", compression=None) as lines:
                        directory = [json.loads(x) for x in lines.read().splitlines()]
                    starts = [x[0] for x in directory]
                    source = store.open_input_file(f"{root}/{name}.cdx.gz")
                # the key's lines may begin in the block before the first one that starts with it
                for at in range(max(0, bisect.bisect_left(starts, key) - 1), bisect.bisect_right(starts, key)):
                    if at != block_at:
                        block, block_at = {}, at
                        for line in gzip.decompress(source.read_at(directory[at][2], directory[at][1])).splitlines():
                            one = json.loads(line)
                            block.setdefault(one[0], []).append(one)
                    rows += block.get(key, [])
                    if len(rows) >= ROWS_AT_ONCE:
                        yield flush()
        yield flush()
        if source is not None:
            source.close()

    placed = keys.select("key").distinct().mapInArrow(place, "key string, shard string")
    # keys of a shard may spread over tasks: each reads the directory and its own blocks
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(read, INDEX)


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Range-read the records: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a
    revisit, or for all if `payloads` is off: then it is checked and left behind).

    Lines are brought into the order of the archives, so that each task reads its ranges forward.
    """
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "payload string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, source = None, None
        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                if row["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["file"], store.open_input_file(f"{root}/{row['file']}")
                fields, http, body = parse(source.read_at(row["length"], row["offset"]))
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and (digest_of(body) != digest or len(body) != int(http["Content-Length"])):
                    raise ValueError(f"the payload at {name}:{row['offset']} is not what its record says")
                number = [int(x) if x else None for x in (fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID"))]
                held.append((number[0], fields["WARC-Target-URI"], int(http["Content-Length"]), digest, fields["WARC-Type"],
                             number[1] if revisit else None, body.decode() if payloads and not revisit else None))
                size += len(body)
                if size > 1 << 25:
                    yield _batch(held)
                    held, size = [], 0
            yield _batch(held)
        if source is not None:
            source.close()

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return captures.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    columns = list(zip(*held, strict=True)) if held else [()] * len(kinds)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)


def url_key(url: Column) -> Column:
    """Sort key of a URL column."""
    def run(urls: pa.Array) -> pa.Array:
        return pa.array([reversed_url(u) for u in urls.to_pylist()], pa.string())

    run.__annotations__ = {"urls": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(url)


def archive_and_read(pages: DataFrame, least: int = 0, payloads: bool = True) -> DataFrame:
    """Write archives and index of all pages, look every page's URL up in the index, and read the records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    shards = write_index(write_archives(pages, folder, least), folder)
    captures = lookup(pages.select(url_key(F.col("url")).alias("key")), shards, folder)
    return read_records(captures, folder, payloads)
