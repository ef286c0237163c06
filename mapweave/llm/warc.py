"""WARC archives with a two-level capture index (operator 7).

Captures are dealt out in ranges of their reversed-host URL key, so that each
task writes one archive and the part of the index that covers it, all in order
of key and page id and all in the shared folder:

- the archive: one gzip member for each WARC record, a response or a revisit
  that names the response with the same payload;
- the index blocks: BLOCK_LINES lines [key, page_id, offset, length] at a
  time, compressed, one after the other in a file;
- the archive's sparse directory: each block's first key and page id, offset and
  length, in a file.

A lookup binary-searches the archives' heads, their first keys, for the archive,
its directory for the block and the block's lines for the captures; every search
comes before a range read. There are MOST_ARCHIVES heads at most, which is what
lookups send to the tasks. Files go through pyarrow's file systems, so the shared
folder can be any that pyarrow knows by its URI; s3a and s3n are s3 there.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import wordhash
from mapweave.llm.scratch import Scratch

BLOCK_LINES = 300
#: Fixed value: the date of all records; the pages table has none.
DATE = "2024-01-01T00:00:00Z"
#: Pages of one archive, about, as long as there are no more than MOST_ARCHIVES; beyond, archives grow.
ARCHIVE_PAGES, MOST_ARCHIVES = 20_000, 50_000
#: Bytes of pages handled at once, and of records that one range read fetches at most, but for a longer record.
CHUNK, READ_BYTES = 1 << 22, 1 << 22
#: One row an archive: its name, and the key and page id that it begins with.
HEADS = "name string, first_key string, first_id long"
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Fixed value: scheme, user, host, port, path and query of a lower-cased URL.
_URL = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^?#]*)([?][^#]*)?"


def surt(url: str | None) -> str:
    """The sort key of a URL: reversed host labels, port, path and query; scheme, user, www, usual ports and fragment are left out.

    Null is empty; what has no host is its own key.
    """
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), url or "").strip(" ")
    if not (m := re.match(_URL, low)):
        return low
    port = "" if m[2] in (None, ":80", ":443") else m[2]
    return ",".join(reversed(re.sub(r"^www[0-9]*\.", "", m[1]).split("."))) + port + ")" + (m[3] or "/") + (m[4] or "")


def surt_column(url: Column) -> Column:
    """surt() as an expression."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.trim(F.translate(F.coalesce(url, F.lit("")), upper, upper.lower()))
    part = lambda k: F.regexp_extract(low, _URL, k)
    host = F.array_join(F.reverse(F.split(F.regexp_replace(part(1), r"^www[0-9]*\.", ""), r"\.")), ",")
    port = F.when(part(2).isin(":80", ":443"), "").otherwise(part(2))
    return F.when(low.rlike(_URL), F.concat(host, port, F.lit(")"), F.when(part(3) == "", "/").otherwise(part(3)), part(4))).otherwise(low)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers: tuple[int, str | None] | None) -> bytes:
    """One gzip member with a WARC/1.1 record: a response, or a revisit of the capture `refers` (id, url)."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    one_line = lambda s: re.sub(r"[\r\n]+", " ", s or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers[0])}", f"WARC-Refers-To-Target-URI: {one_line(refers[1])}", f"X-Refers-To-Page-ID: {refers[0]}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record; a revisit has no payload."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri) if "://" in uri else f"file://{uri}")


def place(key: str, page_id: int | None) -> tuple:
    """What captures are ordered by: the URL key, then the page id, none first."""
    return key, page_id is not None, page_id or 0


def _write(folder: str):
    """Archives, index blocks and directories of the sorted rows of a task; a row of HEADS comes out.

    A task that is run again writes files of new names, and only the names in
    the heads are read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _files(folder)
        name, files, at, lines, directory = "", [], 0, [], []

        def flush() -> None:
            if lines:
                packed = zlib.compress("\n".join(lines).encode(), 6)
                directory.append(json.dumps([*json.loads(lines[0])[:2], files[1].tell(), len(packed)]))
                files[1].write(packed)
                lines.clear()

        first: tuple | None = None
        for row in (r for part in wordhash.chunks(batches, CHUNK, "html") for r in part.to_pylist()):
            if row["first_id"] is not None:  # goes before the pages that it is about
                first = (row["key"], row["page_id"], row["hex"], row["first_id"], row["first_url"])
                continue
            if not files:
                name = f"part-{uuid.uuid4().hex}"
                store.create_dir(base, recursive=True)
                files = [store.open_output_stream(f"{base}/{name}{end}", compression=None) for end in (".warc.gz", ".idx", ".dir")]
            refers = first[3:] if first and first[:3] == (row["key"], row["page_id"], row["hex"]) else None
            member = record(row["page_id"], row["url"], (row["html"] or "").encode(), base64.b32encode(bytes.fromhex(row["hex"])).decode(), refers)
            lines.append(json.dumps([row["key"], row["page_id"], at, len(member)]))
            files[0].write(member)
            at += len(member)
            if len(lines) == BLOCK_LINES:
                flush()
        if files:
            flush()
            files[2].write("\n".join(directory).encode())
            for file in files:
                file.close()
            key, page_id = json.loads(directory[0])[:2]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([key], pa.string()), pa.array([page_id], pa.int64())], names=["name", "first_key", "first_id"])

    return wordhash.tidy(rows)


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives in `folder`; returns their heads, saved.

    Of equal payloads of at least `least_bytes`, the one with the smallest
    page_id is a response and the others revisit it. The payloads are shuffled
    once: which capture a page revisits comes as a row of its own, sorted just
    before the page.
    """
    spark: SparkSession = pages.sparkSession
    text = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", "url", surt_column(F.col("url")).alias("key"), F.sha1(text.cast("binary")).alias("hex"), F.octet_length(text).alias("n"))
    slim = slim.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull())
    first = slim.groupBy("hex").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = scratch.save(first.select(F.col("hex").alias("of"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "first")
    again = slim.join(first, F.col("hex") == F.col("of")).where("page_id <> first_id")
    again = scratch.save(again.select("key", "page_id", "hex", F.lit(0).alias("part"), "first_id", "first_url", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")), "again")
    full = pages.select(surt_column(F.col("url")).alias("key"), "page_id", F.sha1(text.cast("binary")).alias("hex"), F.lit(1).alias("part"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"), "url", "html")
    order = ["key", "page_id", "hex"]
    rows = full.unionByName(again).repartitionByRange(_parts(spark, pages.count()), *order).sortWithinPartitions(*order, "part")
    return scratch.save(rows.mapInArrow(_write(folder), HEADS), "heads")


def _parts(spark: SparkSession, n: int) -> int:
    return min(MOST_ARCHIVES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // ARCHIVE_PAGES + 1))


class Index:
    """The archives in `folder`, by their heads: rows of HEADS in order of place()."""

    def __init__(self, heads: list, folder: str):
        self.store, self.base = _files(folder)
        self.heads = sorted((place(h["first_key"], h["first_id"]), h["name"]) for h in heads)
        self._held: dict[tuple, list] = {}

    def _range(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        with self.store.open_input_file(f"{self.base}/{name}") as file:
            return file.read_at(file.size() if size is None else size, at)

    def _once(self, key: tuple, read) -> list:
        """What was read last for a file or block; lookups come in order, so few are needed again."""
        if key not in self._held:
            if len(self._held) > 3:
                self._held.clear()
            self._held[key] = read()
        return self._held[key]

    def directory(self, name: str) -> list:
        """[place, offset, length] of each block of an archive."""
        return self._once((name,), lambda: [(place(*x[:2]), *x[2:]) for x in map(json.loads, self._range(f"{name}.dir").decode().split("\n"))])

    def block(self, name: str, at: int, size: int) -> list:
        """[place, page id, offset, length] of each capture of a block."""
        return self._once((name, at), lambda: [(place(*x[:2]), *x[1:]) for x in map(json.loads, zlib.decompress(self._range(f"{name}.idx", at, size)).decode().split("\n"))])

    @staticmethod
    def _among(entries: list, low: tuple, high: tuple, before: int) -> list:
        """Entries whose place is from low to high, and `before` ones before them, by binary search."""
        start, stop = bisect.bisect_left(entries, low, key=lambda e: e[0]), bisect.bisect_right(entries, high, key=lambda e: e[0])
        return entries[max(0, start - before) : stop]

    def captures(self, low: tuple, high: tuple) -> Iterator[tuple[str, int, int]]:
        """Archive, offset and length of every capture whose place is from low to high."""
        for _, name in self._among(self.heads, low, high, 1):
            for _, at, size in self._among(self.directory(name), low, high, 1):
                for _, _, start, length in self._among(self.block(name, at, size), low, high, 0):
                    yield name, start, length

    def read(self, found: list[tuple[str, int, int]]) -> Iterator[bytes]:
        """The records of captures, those that follow each other in an archive by one range read of READ_BYTES at most."""
        at = 0
        while at < len(found):
            name, start, length = found[at]
            stop, end = at + 1, start + length
            while stop < len(found) and found[stop][:2] == (name, end) and end + found[stop][2] - start <= READ_BYTES:
                end += found[stop][2]
                stop += 1
            data = self._range(f"{name}.warc.gz", start, end - start)
            for _, s, n in found[at:stop]:
                yield data[s - start : s - start + n]
            at = stop


def find(heads: list, folder: str, url: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
    """All captures of a URL, parsed. `heads`: the rows of write_archives()."""
    index, key = Index(heads, folder), surt(url)
    return [parse(r) for r in index.read(list(index.captures((key,), (key, True, 1 << 63))))]


def _read(heads: list, folder: str):
    """CAPTURES of all records of the sorted (key, page_id) of a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(heads, folder)
        for part in wordhash.chunks(batches, CHUNK >> 4, "key"):
            wanted = zip(part.column("key").to_pylist(), part.column("page_id").to_pylist(), strict=True)
            found, out = [c for at in (place(*w) for w in wanted) for c in index.captures(at, at)], []
            for (name, at, _), member in zip(found, index.read(found), strict=True):
                fields, http, payload = parse(member)
                sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind, n = fields["WARC-Type"], int(http["Content-Length"])
                if kind == "response" and (n != len(payload) or digest(payload) != sha):
                    raise ValueError(f"{name} at {at}: the payload isn't what its header says")
                whole = lambda field, fields=fields: int(fields[field]) if field in fields else None
                out.append((whole("X-Page-ID"), n, sha, kind, whole("X-Refers-To-Page-ID")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return wordhash.tidy(rows)


def look_up(heads: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture of the (url, page_id) in `wanted`.

    Each is looked up in the index, in order of keys, so that a task reads a
    block once. Payloads are checked against their digests. Repeated wanted rows
    count once; what has no capture gives no row.
    """
    spark: SparkSession = heads.sparkSession
    keys = wanted.select(surt_column(F.col("url")).alias("key"), "page_id").distinct()
    ranged = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "page_id").sortWithinPartitions("key", "page_id")
    return ranged.mapInArrow(_read([h.asDict() for h in heads.collect()], folder), CAPTURES)


def round_trip(pages: DataFrame) -> DataFrame:
    """look_up() of all `pages` (page_id, url, html) in what write_archives() wrote of them, in the shared folder.

    Null html is an empty payload, a null url an empty key. A page without id
    is a response and is referred to by none; rows that repeat an id and a
    payload are all responses, or all revisits of the same page. Every row
    gives a row; an empty table gives an empty one.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("archives")
    pages = pages.select("page_id", "url", "html")
    return look_up(write_archives(pages, folder, scratch), folder, pages)
