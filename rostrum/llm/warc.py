"""WARC archives in seekable Zstandard bundles.

A bundle is one file of a task. Records are grouped into independent frames of about
one megabyte; a seek table in a skippable frame at the end lists the sizes of all frames,
so a reader finds any frame from the footer alone. An index maps every record to bundle,
frame and offset in the unpacked frame. Equal payloads are stored once: the record with
the smallest id holds it, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import add_columns, as_bytes, map_batches, register, shared_folder, stored, table

FRAME_BYTES = 1 << 20
# Fixed values of the seekable format: skippable frame, and the mark that ends the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
INDEX = "record_id string, page_id long, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """Id and bytes of a response, or of a revisit that leaves the payload out."""
    own = record_id(page_id, digest)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(body)}")
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """Headers, HTTP headers, payload and end of the record at an offset."""

    def headers(block: bytes) -> dict[str, str]:
        lines = block.decode().split("\r\n")[1:]
        return dict(line.split(": ", 1) for line in lines if ": " in line)

    split = data.index(b"\r\n\r\n", at)
    head = headers(data[at:split])
    end = split + 4 + int(head["Content-Length"])
    body = data[split + 4:end]
    cut = body.index(b"\r\n\r\n")
    return head, headers(body[:cut]), body[cut + 4:], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", packed, plain) for packed, plain in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """Offset, packed and plain size of every frame, from the end of an open file."""
    size = f.size()
    f.seek(size - 9)
    n, flags, mark = struct.unpack("<IBI", f.read(9))
    if mark != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table that this reader knows")
    f.seek(size - 9 - 8 * n)
    sizes = struct.unpack(f"<{2 * n}I", f.read(8 * n))
    out, at = [], 0
    for packed, plain in zip(sizes[::2], sizes[1::2]):
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows of page_id, url, payload, digest and refers_to as bundles; returns the index, stored.

    A task writes under a name of its own attempt and renames at the end, so a repeated task
    leaves the same bundle once.
    """

    def run(batches):
        ctx = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"bundle-{ctx.partitionId():06d}.warc.zst"
        draft = f"{root}/.{name}-{ctx.taskAttemptId()}"
        packer = zstandard.ZstdCompressor(level=3)
        frames: list[tuple[int, int]] = []
        index: list[list] = []
        plain, at = [], 0
        waiting: list[tuple] = []

        with fs.open_output_stream(draft) as out:

            def close_frame() -> None:
                nonlocal plain, at, waiting
                data = b"".join(plain)
                packed = packer.compress(data)
                out.write(packed)
                index.extend([r, p, name, len(frames), at, len(packed), o, n] for r, p, o, n in waiting)
                frames.append((len(packed), len(data)))
                plain, waiting, at = [], [], at + len(packed)

            held = 0
            for b in batches:
                ids, urls, payloads = b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))
                for page, url, payload, digest, first in zip(ids, urls, payloads, b.column(3).to_pylist(), b.column(4).to_pylist()):
                    own, data = record(page, url, payload, digest, first)
                    waiting.append((own, page, held, len(data)))
                    plain.append(data)
                    held += len(data)
                    if held >= FRAME_BYTES:
                        close_frame()
                        held = 0
                if index:
                    yield list(zip(*index))
                    index.clear()
            if plain:
                close_frame()
            out.write(seek_table(frames))
        if frames:
            fs.move(draft, f"{root}/{name}")
        else:
            fs.delete_file(draft)
        if index:
            yield list(zip(*index))

    return stored(map_batches(rows.select("page_id", "url", "payload", "digest", "refers_to"), run, INDEX))


def read_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles named in column ``bundle``, frame by frame as the seek tables list them."""

    def footers(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    frames = read_seek_table(f)
                yield [[name] * len(frames), [a for a, _, _ in frames], [n for _, n, _ in frames], [p for _, _, p in frames]]

    def records(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, at, packed, plain in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
                yield list(zip(*records_of(data)))

    frames = map_batches(bundles.select("bundle"), footers, "bundle string, at long, packed long, plain long")
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(frames.repartition(parts, "bundle", "at"), records, READ)


def records_of(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        head, http, payload, at = parse(data, at)
        kind = head["WARC-Type"]
        digest = digest_of(payload) if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha1:")
        page, first = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
        size = len(payload) if kind == "response" else int(http["Content-Length"])
        yield page and int(page), size, digest, kind, first and int(first)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """Payload of single records by their index rows: one frame is read for each."""

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            ids, payloads = [], []
            for rid, name, at, packed, offset in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(at)
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(packed))
                ids.append(rid)
                payloads.append(parse(data, offset)[2])
            yield ids, payloads

    return map_batches(index.select("record_id", "bundle", "frame_offset", "frame_bytes", "record_offset"), run,
                       "record_id string, payload binary")


def archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of page_id, url and html; returns the index.

    Null html is an empty payload. Of equal payloads of at least ``min_bytes`` bytes the
    smallest page_id is the response (null ids come last; rows that repeat that id are
    responses too), the others revisit it. Other columns are ignored.
    """

    def digests(html):
        payloads = as_bytes(html)
        return [payloads, [digest_of(p) for p in payloads], [len(p) for p in payloads]]

    rows = add_columns(pages, ["html"], digests, "payload binary, digest string, size long", keep=["page_id", "url"])
    keys = add_columns(pages, ["html"], lambda html: digests(html)[1:], "digest string, size long", keep=["page_id"])
    # Only digests that repeat are joined; the planner sees their stored size and broadcasts them if that is small.
    first = stored(keys.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                   .where("n > 1").select("digest", "first"))
    rows = rows.join(first, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    return write_bundles(rows, folder)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (SELECT page_id, n, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(x, CAST(i // 4 AS INT) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INT))) & 31 AS INT) + 1, 1)),
        'string_agg', '') AS digest FROM h),
f AS (SELECT digest, min(page_id) AS first FROM d GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (digest)
"""


@register("op5_warc", SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages in the shared folder, then read the archives back."""
    folder = f"{shared_folder(spark)}-warc"
    index = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_bundles(index.select("bundle").distinct(), folder)
