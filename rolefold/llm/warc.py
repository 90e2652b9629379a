"""WARC archives as seekable Zstandard bundles.

A bundle is a ``.warc.zst`` file: records grouped into independent frames, then
a skippable frame with the seek table (the public Zstandard seekable format), so
any Zstandard tool reads the whole and a reader of one record decompresses one
frame.  An index table maps each record to bundle, frame, the frame's place in
the file and the record's place in the frame.

Tasks write bundles under names of their own and hand on index rows; only
bundles that the committed index names count, so a lost executor's half-written
files are never read.  Bundles are written with pyarrow's file systems (local,
HDFS, S3, GCS by the folder's URI) and read back the same way.

Defined cases: an empty table has no records; payloads of any length are written
whole; other columns stay out; a null payload is empty; payloads under ``revisit_bytes`` are
always responses; rows with an equal payload and the largest id are all
responses; a null id is never the largest, and a group of null ids only holds
responses; null urls are written as ``urn:none``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir, width

SEEK_MAGIC, SKIP_MAGIC = 0x8F92EAB1, 0x184D2A5E
INDEX = (
    "record_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
)
READ = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# ------------------------------------------------------------------ records


def record(record_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (payload None) names the response and has no body."""
    kind = "revisit" if payload is None else "response"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{'none' if record_id is None else record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + ("urn:none" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers_to}>"]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes | memoryview, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the place after it."""
    data = bytes(data) if not isinstance(data, bytes) else data
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    block = data[start : start + size]
    body = block[block.index(b"\r\n\r\n") + 4 :]
    number = lambda name: None if head.get(name, "<urn:record:none>") == "<urn:record:none>" else int(head[name][12:-1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(head["X-Payload-Length"])):
        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
    url = head["WARC-Target-URI"]
    return {
        "record_id": number("WARC-Record-ID"),
        "url": None if url == "urn:none" else url,
        "record_type": head["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload_bytes": int(head["X-Payload-Length"]),
        "payload_digest": digest,
        "payload": body if head["WARC-Type"] == "response" else None,
    }, start + size + 4


# ------------------------------------------------------------------ bundles


class BundleWriter:
    """Frames of about ``frame_bytes`` plain bytes, a new file after ``bundle_bytes`` written ones."""

    def __init__(self, folder: str, level: int, frame_bytes: int, bundle_bytes: int):
        import zstandard
        from pyarrow import fs

        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.out = None
        self._fresh()

    def _fresh(self) -> None:
        self.held, self.size, self.table, self.at = [], 0, [], 0

    def add(self, row: tuple, data: bytes) -> Iterator[tuple]:
        """Index rows of a frame, once it is written."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.held.append((row, data))
        self.size += len(data)
        if self.size >= self.frame_bytes:
            yield from self.flush()
            if self.at >= self.bundle_bytes:
                self.close()

    def flush(self) -> Iterator[tuple]:
        if self.held:
            frame = self.pack.compress(b"".join(d for _, d in self.held))
            self.out.write(frame)
            offset = 0
            for row, data in self.held:
                yield (*row, self.name, len(self.table), self.at, len(frame), offset, len(data))
                offset += len(data)
            self.table.append((len(frame), self.size))
            self.at += len(frame)
            self.held, self.size = [], 0

    def close(self) -> None:
        if self.out is not None:
            entries = b"".join(struct.pack("<II", *x) for x in self.table)
            footer = struct.pack("<IBI", len(self.table), 0, SEEK_MAGIC)
            self.out.write(struct.pack("<II", SKIP_MAGIC, len(entries) + len(footer)) + entries + footer)
            self.out.close()
            self.out = None
            self._fresh()


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain) of each frame, from the end of a bundle."""
    frames, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    table = data[len(data) - 9 - frames * each : len(data) - 9]
    out, at = [], 0
    for n in range(frames):
        packed, plain = struct.unpack_from("<II", table, n * each)
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(
    df: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = 1000,
    level: int = 3,
    frame_bytes: int = 256 << 10,
    bundle_bytes: int = 16 << 20,
) -> DataFrame:
    """Write one record per row into bundles under ``folder``; the stored index table."""
    payload = F.encode(F.coalesce(df[payload_col].cast("string"), F.lit("")), "UTF-8")
    rows = df.select(df[id_col].cast("long").alias("record_id"), df[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    big = rows.where(F.col("size") >= revisit_bytes)
    kept = big.groupBy("digest", "size").agg(F.max("record_id").alias("kept"))
    kept = saved(kept, "kept")
    columns = ["record_id", "url", "digest", "size", "payload", "refers_to"]
    none = F.lit(None).cast("long").alias("refers_to")
    small = rows.where(F.col("size") < revisit_bytes).select("*", none)
    # payloads move by (digest, id), so copies of one page spread over tasks, and only a response's moves on;
    # revisits need no payload and are joined without it
    holders = kept.select("digest", "size", F.col("kept").alias("record_id"))
    response = big.join(holders, ["digest", "size", "record_id"], "left_semi").select("*", none)
    again = big.where("record_id IS NOT NULL").drop("payload").join(kept, ["digest", "size"]).where("record_id <> kept")
    again = again.select("*", F.lit(None).cast("binary").alias("payload"), F.col("kept").alias("refers_to"))
    nameless = big.where("record_id IS NULL").join(kept, ["digest", "size"])
    nameless = nameless.select("record_id", "url", "digest", "size", F.when(F.col("kept").isNull(), F.col("payload")).alias("payload"), F.col("kept").alias("refers_to"))
    rows = small.select(columns).union(response.select(columns)).union(again.select(columns)).union(nameless.select(columns))
    rows = rows.select("record_id", "url", "digest", "size", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = BundleWriter(folder, level, frame_bytes, bundle_bytes)
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 4

        def table(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            found: list[tuple] = []
            for record_id, url, digest, size, body, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind = "response" if body is not None else "revisit"
                found += out.add((record_id, kind, refers, size, digest), record(record_id, url, digest, size, body, refers))
            yield table(found)
        yield table(list(out.flush()))
        out.close()

    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return saved(rows.mapInArrow(run, INDEX), "warc-index")


def _frame_rows(frame: bytes) -> Iterator[dict]:
    import zstandard

    data, at = zstandard.ZstdDecompressor().decompress(frame), 0
    while at < len(data):
        found, at = parse(data, at)
        yield found


_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _read_batch(found: list[dict], payloads: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in READ.split(", ")]
    if not payloads:
        names, kinds = names[:-1], _KINDS[:-1]
    else:
        kinds = _KINDS
    cols = [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=names)


def read_bundles(spark: SparkSession, folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame, digests verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            for bundle in b.column(0).to_pylist():
                with files.open_input_file(f"{path}/{bundle}") as f:
                    data = f.read()
                for at, packed, _ in seek_table(data):
                    yield _read_batch(list(_frame_rows(data[at : at + packed])), payloads)

    # names are dealt out, bundles are read where they are needed
    named = index.select("bundle").distinct().repartition(width(spark))  # by number: never merged into fewer tasks
    schema = READ if payloads else READ.removesuffix(", payload binary")
    return named.mapInArrow(run, schema)


def lookup(folder: str, index: DataFrame) -> DataFrame:
    """The records of some index rows: one seek, one frame and one slice each, nothing else is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            found = []
            for bundle, at, packed, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with files.open_input_file(f"{path}/{bundle}") as f:
                    f.seek(at)
                    plain = zstandard.ZstdDecompressor().decompress(f.read(packed))
                found.append(parse(plain[start : start + size])[0])
            yield _read_batch(found, True)

    return index.select("bundle", "frame_offset", "frame_bytes", "record_offset", "record_bytes").mapInArrow(run, READ)


def archive_round_trip(df: DataFrame, **options) -> DataFrame:
    """Write a table's records to a new folder of bundles and read all of them back."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_bundles(df, folder, **options)
    return read_bundles(spark, folder, index, payloads=False)
