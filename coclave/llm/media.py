"""Media columns: payloads kept as 8-bit greyscale images in archives, and a Spark data source that reads them.

Archives are ordinary ZIP files of uncompressed members. A member is a PNG whose samples are the payload's bytes, 64 a row, with
the unpadded length in a tEXt chunk. Tasks write archives straight into the shared folder and return a manifest row for each
finished file, so what a lost or repeated attempt left behind is never read. The reader plans byte ranges over the archives;
a task reads its archive's directory, takes the members whose offset lies in its range, and reads each by offset, again if need be.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from coclave.runtime import fresh_path, mapped, ready

ROW = 64
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
FOOT, ENTRY, LOCAL = struct.Struct("<4s4H2IH"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s5H3I2H")


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(raw: bytes) -> bytes:
    """The padded payload as a greyscale image 64 wide; the bytes depend on the payload only."""
    rows = np.frombuffer(pad(raw), np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"".join(
        (PNG_SIGNATURE, _chunk(b"IHDR", head), _chunk(b"tEXt", b"bytes\0%d" % len(raw)), _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)), _chunk(b"IEND", b""))
    )


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(payload with its padding, unpadded length); an error if any chunk is damaged."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, data, n, size = 8, [], None, None
    while at < len(media):
        (length,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + length)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("unknown line filter")
    return np.ascontiguousarray(lines[:, 1:]).tobytes(), n


def describe(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, then the share of each band of 16 values; equal payloads, equal strings."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(np.float64)
    share = counts / counts.sum()
    values = np.arange(256.0)
    mean = float(share @ values)
    spread = float(share @ (values - mean) ** 2) ** 0.5
    some = share[share > 0]
    bands = share.reshape(16, 16).sum(1)
    return ",".join(f"{x:.6f}" for x in (mean, spread, abs(float(-(some * np.log2(some)).sum())), *bands))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Members of an archive at most: the counts of a ZIP's foot are 16 bits wide.
MEMBERS = 65_535


class ArchiveWriter:
    """For mapped() over (key, text): writes archives, yields a manifest row for each that is finished."""

    def __init__(self, folder: str, archive_bytes: int):
        self.folder, self.archive_bytes = folder, archive_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(self.folder)
        system.create_dir(root, recursive=True)
        out, name, entries, at = None, "", [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = encode_png((t.as_py() or "").encode())
                if out is None:
                    name, entries, at = f"{uuid.uuid4().hex}.zip", [], 0
                    out = system.open_output_stream(f"{root}/{name}")
                label, crc = (b"null" if k is None else b"%d" % k) + b".png", zlib.crc32(media)
                entries.append(ENTRY.pack(b"PK\1\2", 20, 20, 0, 0, 0, 33, crc, len(media), len(media), len(label), 0, 0, 0, 0, 0, at) + label)
                out.write(LOCAL.pack(b"PK\3\4", 20, 0, 0, 0, 33, crc, len(media), len(media), len(label), 0) + label)
                out.write(media)
                at += LOCAL.size + len(label) + len(media)
                if at >= self.archive_bytes or len(entries) == MEMBERS:
                    yield self._finish(out, name, entries, at)
                    out = None
        if out is not None:
            yield self._finish(out, name, entries, at)

    @staticmethod
    def _finish(out: pa.NativeFile, name: str, entries: list[bytes], at: int) -> pa.RecordBatch:
        directory = b"".join(entries)
        out.write(directory)
        out.write(FOOT.pack(b"PK\5\6", 0, 0, len(entries), len(entries), len(directory), at, 0))
        out.close()
        return pa.RecordBatch.from_pydict({"archive": [name], "bytes": [at + len(directory) + FOOT.size], "members": [len(entries)]})


def write_archives(docs: DataFrame, key: str, text: str, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Lay every row's text (null: empty) into archives in `folder`; (archive, bytes, members) of the finished ones.

    A row's member is named by its key ("null" for a null key). Keys may repeat: members are told apart by offset.
    """
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return mapped(rows, ArchiveWriter(folder, archive_bytes).__call__, "archive string, bytes long, members long")


class ByteRange(InputPartition):
    def __init__(self, archive: str, size: int, start: int, stop: int):
        self.archive, self.size, self.start, self.stop = archive, size, start, stop


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("splitbytes", 64 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> list[ByteRange]:
        system, root = _open(self.folder)
        with system.open_input_stream(f"{root}/manifest.json") as f:
            listed = json.loads(f.read())
        return [ByteRange(name, size, at, min(at + self.split, size)) for name, size in listed for at in range(0, size, self.split)] or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        system, root = _open(self.folder)
        path = f"{root}/{part.archive}"
        f = system.open_input_file(path)

        def fetch(offset: int, length: int) -> bytes:
            nonlocal f
            for k in range(self.tries):
                try:
                    got = f.read_at(length, offset)
                    if len(got) == length:
                        return got
                    raise OSError(f"{path}: {len(got)} of {length} bytes at {offset}")
                except OSError:
                    if k + 1 == self.tries:
                        raise
                    time.sleep(0.2 * 2**k)
                    f = system.open_input_file(path)
            raise AssertionError

        def member(offset: int, length: int, name: int, crc: int) -> bytes:
            """Each member on its own: read again from its offset while its checksum is wrong."""
            for k in range(self.tries):
                media = fetch(offset + LOCAL.size + name, length)
                if zlib.crc32(media) == crc:
                    return media
            raise OSError(f"{path}: damaged member at {offset}")

        foot = FOOT.unpack(fetch(part.size - FOOT.size, FOOT.size))
        directory = fetch(foot[6], foot[5])
        at, rows, held = 0, [], 0
        while at < len(directory):
            e = ENTRY.unpack_from(directory, at)
            name = directory[at + ENTRY.size : at + ENTRY.size + e[10]].decode()
            at += ENTRY.size + e[10] + e[11] + e[12]
            if part.start <= e[16] < part.stop:
                rows.append((part.archive, e[16], name.removesuffix(".png"), member(e[16], e[8], e[10], e[7])))
                held += e[8]
                if held >= self.batch:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        a, o, k, m = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(o, pa.int64()), pa.array([None if x == "null" else int(x) for x in k], pa.int64()), pa.array(m, pa.binary())], ["archive", "offset", "key", "media"])


class MediaSource(DataSource):
    """format("coclave_media"): options path (a folder with a manifest), splitBytes, batchBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "coclave_media"

    def schema(self) -> str:
        return "archive string, offset long, key long, media binary"

    def reader(self, schema: object) -> MediaReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, archive_bytes: int = 256 << 20) -> str:
    """Write the archives and their manifest; the folder. The manifest has one line per archive, as a file listing has."""
    ready(docs.sparkSession)
    folder = folder or fresh_path(docs.sparkSession, "media")
    done = write_archives(docs, key, text, folder, archive_bytes).select("archive", "bytes").collect()
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(sorted([r["archive"], r["bytes"]] for r in done)).encode())
    return folder


def read_media(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """(archive, offset, key, media) of every member."""
    spark.dataSource.register(MediaSource)
    reader = spark.read.format("coclave_media")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(folder)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    for batch in batches:
        rows = []
        for m in batch.column(1):
            stored = m.as_buffer().to_pybytes()
            payload, n = decode_png(stored)
            rows.append((n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(stored), sha256(stored).hexdigest(), describe(payload)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["key", *names])


def media_features(media: DataFrame) -> DataFrame:
    """One row per member: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return mapped(
        media.select("key", "media"),
        _features, "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as media, read the stored bytes back through the data source and describe them.

    One row per input row. Null and empty texts are 64 zero bytes; null keys come back null; repeated rows come back as often as
    they went in; other columns are ignored; an empty table gives no rows. A text is held whole in memory, twice at most.
    """
    folder = store_media(docs, key, text)
    return media_features(read_media(docs.sparkSession, folder)).withColumnRenamed("key", key)
