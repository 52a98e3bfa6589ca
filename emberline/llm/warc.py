"""Operator 4: WARC archives with a two-level capture index.

Writing: each partition of pages becomes one archive of gzip members, a record each. Among equal
payloads the smallest page_id is the response and the others are revisits of it, without a body.
Every capture gives an index line keyed by its URL in reversed-host order.

Index: lines are dealt by range of key and sorted; each range becomes one index file of compressed
blocks of BLOCK_LINES lines, and a directory with the first key, place and length of each block. A
catalogue row for each index file holds the first key of the range.

Reading: a request is a key. The catalogue is searched for the file, its directory for the block,
the block for the line, each by bisection, and then only the record's bytes are read from the
archive. Requests are sorted alike, so a task reads neighbouring blocks, and caches are bounded.

Files lie in the shared folder. Each attempt of a task writes a file of its own, renamed when whole,
and its captures name that file; what an attempt that was lost has written is never read.

Null html is an empty payload, a null url an empty key. Rows with the same smallest page_id and
payload are all responses, and as their records are equal they have one record id. A null page_id ranks last
and is never referred to unless all are null. An empty table gives no archive, an empty catalogue and no row.
Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import LONG_MAX, partitions, scratch, small_batches, stage, table
from emberline.llm.tokens import columns, task_number

BLOCK_LINES = 500
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, archive string, offset long, length long, digest string, kind string"
CATALOGUE = "first string, file string, directory string, lines long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_offset long, record_length long"


def reversed_host(url: str) -> str:
    """The sort key of a URL: host labels from the last to the first, then port, path and query, in lower case
    for the host, without scheme, user, fragment or a leading www."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str, page_id: int | None) -> str:
    return f"{reversed_host(url)} {page_id if page_id is not None else -1:020d}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def put(folder: str, name: str, chunks: Iterator[bytes]) -> str:
    """Write a file whole or not at all, under a name of its own; returns that name."""
    store, base = open_fs(folder)
    store.create_dir(base, recursive=True)
    stem, _, kind = name.partition(".")
    name = f"{stem}-{uuid.uuid4().hex}.{kind}"
    with store.open_output_stream(f"{base}/.{name}", compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(f"{base}/.{name}", f"{base}/{name}")
    return name


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """A gzip member with one record; first is the page that a revisit refers to."""
    kind = "response" if first is None else "revisit"
    body = b"" if first is not None else payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "text/html; charset=utf-8",
    }
    if first is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{first}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Payload-Length": str(len(payload))}
    head["Content-Length"] = str(len(body))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    data = zlib.decompress(member, 31)
    at = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[:at].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    n = int(head["Content-Length"])
    body = data[at + 4 : at + 4 + n]
    if not data.startswith(b"WARC/1.1\r\n") or len(body) != n or data[at + 4 + n :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return head, body


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages; returns the captures, staged."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rank = F.coalesce("page_id", F.lit(LONG_MAX)).alias("rank")
    sums = rows.select(rank, F.sha1("html").alias("sha1"))
    many = sums.groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).where("n > 1").select("sha1", "first")
    marked = stage(sums.join(many, "sha1").where("rank > first").distinct(), "revisits")
    known = rows.withColumn("rank", rank).withColumn("sha1", F.sha1("html")).join(marked, ["rank", "sha1"], "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []

        def members() -> Iterator[bytes]:
            at = 0
            for batch in batches:
                for page_id, url, html, first in zip(*columns(batch, "page_id", "url", "html", "first"), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = digest32(payload)
                    out = record(page_id, url, payload, digest, first)
                    lines.append((capture_key(url, page_id), at, len(out), digest, "response" if first is None else "revisit"))
                    at += len(out)
                    yield out

        name = put(folder, f"part-{task_number():05d}.warc.gz", members())
        yield _batch([(x[0], name, *x[1:]) for x in lines], CAPTURES)

    return stage(known.mapInArrow(run, CAPTURES), "captures")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str, str]]:
    """Write the index files; returns the catalogue, a row for each partition: (first key, file, directory)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, total, first = [], 0, None

        def blocks() -> Iterator[bytes]:
            nonlocal total, first
            held, at = [], 0

            def block() -> bytes:
                nonlocal at
                out = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"), 6)
                directory.append(json.dumps([json.loads(held[0])[0], at, len(out)]))
                at += len(out)
                return out

            for batch in batches:
                for row in zip(*columns(batch, "key", "archive", "offset", "length", "digest", "kind"), strict=True):
                    first = row[0] if first is None else first
                    held.append(json.dumps(row))
                    total += 1
                    if len(held) == block_lines:
                        yield block()
                        held = []
            if held:
                yield block()

        name = f"index-{task_number():05d}"
        file = put(folder, f"{name}.cdx", blocks())
        if total:
            sparse = put(folder, f"{name}.dir", iter(["\n".join(directory).encode("utf-8", "surrogatepass")]))
            yield _batch([(first, file, sparse, total)], CATALOGUE)

    ranged = captures.repartitionByRange(partitions(captures), "key").sortWithinPartitions("key", "archive", "offset")
    return sorted((r["first"], r["file"], r["directory"]) for r in ranged.mapInArrow(run, CATALOGUE).collect())


class CaptureIndex:
    """Look-ups by key. Holds the catalogue, and few directories, blocks and payload lengths at a time."""

    def __init__(self, folder: str, catalogue: list[tuple[str, str, str]], directories: int = 8, blocks: int = 32):
        self.folder, self.catalogue = folder, catalogue
        self.store, self.base = open_fs(folder)
        self.firsts = [c[0] for c in catalogue]
        self._limits = {"directory": directories, "block": blocks, "archive": 16}
        self._held: dict[str, OrderedDict] = {k: OrderedDict() for k in self._limits}

    def _cached(self, kind: str, key, make):
        held = self._held[kind]
        if key in held:
            held.move_to_end(key)
            return held[key]
        if len(held) >= self._limits[kind]:
            held.popitem(last=False)
        held[key] = made = make()
        return made

    def _directory(self, path: str) -> tuple[list[str], list[list]]:
        with self.store.open_input_stream(f"{self.base}/{path}", compression=None) as f:
            rows = [json.loads(x) for x in f.read().decode("utf-8", "surrogatepass").split("\n")]
        return [r[0] for r in rows], rows

    def _range(self, path: str, offset: int, length: int) -> bytes:
        f = self._cached("archive", path, lambda: self.store.open_input_file(f"{self.base}/{path}"))
        f.seek(offset)
        return f.read(length)

    def _block(self, path: str, offset: int, length: int) -> tuple[list[str], list[list]]:
        rows = [json.loads(x) for x in zlib.decompress(self._range(path, offset, length)).decode("utf-8", "surrogatepass").split("\n")]
        return [r[0] for r in rows], rows

    def find(self, key: str) -> list[list]:
        """All captures with a key; equal keys can lie on both sides of a block's end."""
        out = []
        shard = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while shard < len(self.catalogue) and self.firsts[shard] <= key:
            _, file, sparse = self.catalogue[shard]
            keys, rows = self._cached("directory", sparse, lambda sparse=sparse: self._directory(sparse))
            b = max(0, bisect.bisect_left(keys, key) - 1)
            while b < len(rows) and keys[b] <= key:
                _, at, n = rows[b]
                names, lines = self._cached("block", (file, at), lambda file=file, at=at, n=n: self._block(file, at, n))
                i = bisect.bisect_left(names, key)
                while i < len(names) and names[i] == key:
                    out.append(lines[i])
                    i += 1
                b += 1
            shard += 1
        return out

    def read(self, capture: list) -> tuple[dict[str, str], bytes]:
        _, archive, offset, length, *_ = capture
        return parse(self._range(archive, offset, length))


def read_back(requests: DataFrame, folder: str, catalogue: list[tuple[str, str, str]]) -> DataFrame:
    """Look up each distinct (key, n) of requests and read its n captures from the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, catalogue)
        for batch in batches:
            rows = []
            for key, n in zip(*columns(batch, "key", "n"), strict=True):
                found = index.find(key)
                if len(found) != n:
                    raise ValueError(f"{len(found)} captures of {key}; {n} were written")
                for capture in found:
                    head, body = index.read(capture)
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest32(body) != digest:
                        raise ValueError(f"payload of {key} doesn't have its digest")
                    page = head["WARC-Record-ID"][len("<urn:page:") : -1]
                    rows.append((int(page) if page else None, int(head["X-Payload-Length"]) if revisit else len(body), digest, head["WARC-Type"], int(head["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None, head["WARC-Target-URI"], capture[2], capture[3]))
            yield _batch(rows, RESULT)

    ranged = requests.repartitionByRange(partitions(requests), "key").sortWithinPartitions("key")
    return ranged.mapInArrow(run, RESULT)


def archive(pages: DataFrame, folder: str) -> tuple[str, list[tuple[str, str, str]], DataFrame]:
    """Write pages and their index under folder: (folder, catalogue, captures)."""
    captures = write_archives(pages, folder)
    return folder, write_index(captures, folder), captures


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder, catalogue, captures = archive(pages, scratch(spark, "warc"))
    requests = captures.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return read_back(requests, folder, catalogue)


