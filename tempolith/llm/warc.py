"""WARC archives with a two-level capture index.

Writing: pages are range-partitioned by (reversed-host URL key, id, digest).  The
verdicts "this payload was first captured by page x", which come from an
aggregation over digests, travel in the same shuffle as rows of their own that
sort just before the pages they are about, so the payloads are shuffled once.  Each task
writes one archive of gzip members, one for each record, under a name of its
own attempt; the index rows name the file that was written, so a task that is
run again leaves the index whole.

Index: the records of an archive are in key order already.  Each task writes
their index lines in compressed blocks of ``BLOCK`` lines beside the archive,
and a sparse directory with the first key of each block; a table lists the
first key of each directory, one row for each task.

Reading: a lookup finds its directories by binary search among the directories'
first keys, its block by binary search in the directory, its line by binary
search in the block, and reads the record's range from the archive.  Lookups
are dealt by directory and sorted, so each block is read once.

Defined results: null html is the empty payload; payloads under ``REVISIT_FROM``
bytes are always responses; null urls have the empty key and null ids come
last (the id 2^63 - 1 is reserved for them and reads as null).  Of rows with the
smallest id and an equal payload, the one with the smallest key is the response,
of rows repeated outright the first; all others are written as revisits of it,
and read back as such.  Rows that share an id but not a payload are captures of
their own.  Very long payloads are one record each.  No pages give no archives
and an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches
from .shared import fresh_path, shuffle_parts, written

REVISIT_FROM = 100
BLOCK = 500
LAST_ID = (1 << 63) - 1


def url_key(url):
    """Column: the host's labels reversed and joined by commas, then ``)`` and the rest, lower case.
    Scheme, user, port and a leading ``www`` do not count."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^.*@|:\d*$", ""), r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


def _open(path: str):
    """(file system, path in it) for a URI, by Arrow's connectors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def record(kind: str, uri: str, page_id: int, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, a gzip member of its own.  A revisit carries no payload."""
    headers = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri} {digest}')}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        f"WARC-Page-ID: {page_id}",
    ]
    if kind == "revisit":
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    headers += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(headers).encode()) + squeeze.compress(payload) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its content")
    return headers, rest[:n]


class _Archive:
    """The archive, index blocks and directory that one task writes."""

    def __init__(self, folder: str):
        t = TaskContext.get()
        self.name = f"{folder}/part-{t.partitionId():06d}-{uuid.uuid4().hex[:8]}"
        fs, path = _open(self.name)
        fs.create_dir(path.rsplit("/", 1)[0])
        self.warc = fs.open_output_stream(path + ".warc.gz", compression=None)
        self.blocks = fs.open_output_stream(path + ".idx", compression=None)
        self.fs, self.path = fs, path
        self.at = self.block_at = self.count = 0
        self.lines: list[str] = []
        self.directory: list[str] = []
        self.first: tuple[str, int] | None = None

    def add(self, key: str, page_id: int, member: bytes) -> None:
        if self.first is None:
            self.first = (key, page_id)
        self.warc.write(member)
        self.lines.append(f"{key}\t{page_id}\t{self.at}\t{len(member)}")
        self.at += len(member)
        self.count += 1
        if len(self.lines) == BLOCK:
            self._flush()

    def _flush(self) -> None:
        data = zlib.compress("\n".join(self.lines).encode(), 6)
        key, page_id = self.lines[0].split("\t")[:2]
        self.directory.append(f"{key}\t{page_id}\t{self.block_at}\t{len(data)}")
        self.blocks.write(data)
        self.block_at += len(data)
        self.lines = []

    def close(self) -> None:
        if self.lines:
            self._flush()
        self.warc.close()
        self.blocks.close()
        with self.fs.open_output_stream(self.path + ".dir", compression=None) as f:
            f.write("\n".join(self.directory).encode())


SHARDS = "name string, first_key string, first_id long, records long, bytes long"


def _clean(key: str) -> str:
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, verdict, last = None, None, None
        for pdf in batches:
            for key, i, kind, url, data, digest, refers in zip(*(pdf[c] for c in ("key", "id", "kind", "url", "payload", "digest", "refers_to")), strict=True):
                if kind == 0:
                    verdict = (key, i, digest, int(refers))
                    continue
                refers_to = verdict[3] if verdict and verdict[:3] == (key, i, digest) else None
                if refers_to is None and len(data) >= REVISIT_FROM and last == (key, i, digest):
                    refers_to = i  # a row repeated outright
                last = (key, i, digest)
                archive = archive or _Archive(folder)
                kind_of = "response" if refers_to is None else "revisit"
                archive.add(key, i, record(kind_of, _clean(url or ""), i, data, len(data), digest, refers_to))
        if archive:
            archive.close()
            yield pd.DataFrame([(archive.name, *archive.first, archive.count, archive.at)], columns=["name", "first_key", "first_id", "records", "bytes"])

    return run


@dataclass
class Captures:
    """Written archives.  ``shards``: one row for each writing task."""

    folder: str
    shards: DataFrame


def with_keys(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """key and id of each row."""
    return pages.select(F.regexp_replace(url_key(F.col(url_col)), r"[\t\n\r]", " ").alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"))


def write_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Captures:
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(
        F.regexp_replace(url_key(F.col(url_col)), r"[\t\n\r]", " ").alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    long_ones = base.where(F.octet_length("payload") >= REVISIT_FROM).select("key", "id", "digest")
    small = written(long_ones.distinct(), "captures")
    # the response of a digest: the smallest id, of its rows the smallest key; the rest revisit it
    first = small.groupBy("digest").agg(F.min(F.struct("id", "key")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = small.join(first, "digest").where(F.struct("id", "key") != F.col("first"))
    none = lambda t: F.lit(None).cast(t)
    verdicts = again.select("key", "id", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), "digest", F.col("first.id").alias("refers_to"))
    rows = base.select("key", "id", F.lit(1).alias("kind"), "url", "payload", "digest", F.lit(0).cast("long").alias("refers_to"))
    ranged = verdicts.unionByName(rows).repartitionByRange(shuffle_parts(spark), "key", "id", "digest").sortWithinPartitions("key", "id", "digest", "kind")
    folder = fresh_path(spark, "warc")
    shards = written(map_batches(ranged, _write(folder), SHARDS), "shards")
    return Captures(folder, shards)


FOUND = "key string, id long, payload_bytes long, payload_digest string, record_type string, refers_to long, content binary"


class _Shard:
    """Reads one task's directory, blocks and archive."""

    def __init__(self, name: str):
        self.fs, self.path = _open(name)
        with self.fs.open_input_stream(self.path + ".dir", compression=None) as f:
            rows = [x.split("\t") for x in f.read().decode().split("\n") if x]
        self.keys = [(k, int(i)) for k, i, *_ in rows]
        self.places = [(int(a), int(n)) for *_, a, n in rows]
        self.blocks = self.fs.open_input_file(self.path + ".idx")
        self.warc = self.fs.open_input_file(self.path + ".warc.gz")
        self.loaded, self.lines, self.line_keys = -1, [], []

    def close(self) -> None:
        self.blocks.close()
        self.warc.close()

    def _load(self, b: int) -> None:
        if b != self.loaded:
            at, n = self.places[b]
            self.blocks.seek(at)
            self.lines = [x.split("\t") for x in zlib.decompress(self.blocks.read(n)).decode().split("\n")]
            self.line_keys = [(k, int(i)) for k, i, *_ in self.lines]
            self.loaded = b

    def find(self, key: str, page_id: int) -> Iterator[bytes]:
        """The records of a key and id, gzip members."""
        b = max(0, bisect.bisect_left(self.keys, (key, page_id)) - 1)
        while b < len(self.keys) and self.keys[b] <= (key, page_id):
            self._load(b)
            at = bisect.bisect_left(self.line_keys, (key, page_id))
            while at < len(self.lines) and self.line_keys[at] == (key, page_id):
                offset, n = map(int, self.lines[at][2:])
                self.warc.seek(offset)
                yield self.warc.read(n)
                at += 1
            if at < len(self.lines):
                return
            b += 1


def lookup(captures: Captures, wanted: DataFrame, content: bool = False) -> DataFrame:
    """For rows (key, id): what the archives hold of them, and with ``content`` the payloads
    of responses (empty for revisits).  A wanted row that is repeated counts once."""
    spark = wanted.sparkSession
    # one row for each writing task
    shards = sorted((r["first_key"], r["first_id"], r["name"]) for r in captures.shards.select("first_key", "first_id", "name").collect())
    firsts, names = [(k, i) for k, i, _ in shards], [n for *_, n in shards]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # captures of one key and id may fill several archives
            asked = list(zip(pdf["key"], pdf["id"], strict=True))
            first = np.array([max(0, bisect.bisect_left(firsts, x) - 1) for x in asked], "int64")
            last = np.array([bisect.bisect_right(firsts, x) for x in asked], "int64")
            out = pdf.loc[pdf.index.repeat(np.maximum(last - first, 0))]
            out["shard"] = np.concatenate([np.empty(0, "int64"), *map(np.arange, first, last)])
            yield out

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, shard, last = -1, None, None
        for pdf in batches:
            out = []
            for s, key, i in zip(pdf["shard"], pdf["key"], pdf["id"], strict=True):
                if (s, key, i) == last:
                    continue
                last = (s, key, i)
                if s != at:
                    if shard:
                        shard.close()
                    at, shard = s, _Shard(names[s])
                for member in shard.find(key, i):
                    h, body = parse(member)
                    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(h["WARC-Payload-Length"])
                    if kind == "response":
                        size = len(body)
                        if hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"the payload of page {i} does not match its digest")
                    refers = h.get("WARC-Refers-To-Page-ID")
                    out.append((key, i, size, digest, kind, int(refers) if refers else None, body if content else None))
            cols = ["key", "id", "payload_bytes", "payload_digest", "record_type", "refers_to", "content"]
            done = pd.DataFrame(out, columns=cols)
            # straight from the numbers: by way of floats long ids would change
            done["refers_to"] = pd.array([r[5] for r in out], dtype="Int64")
            yield done
        if shard:
            shard.close()

    routed = map_batches(wanted.select("key", "id"), route, "key string, id long, shard long")
    dealt = routed.repartition(shuffle_parts(spark), "shard").sortWithinPartitions("shard", "key", "id")
    return map_batches(dealt, read, FOUND)


def capture_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages and read all of them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    captures = write_captures(pages, id_col, url_col, html_col)
    found = lookup(captures, with_keys(pages, id_col, url_col).distinct())
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return found.select(real("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", real("refers_to").alias("refers_to"))


SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
