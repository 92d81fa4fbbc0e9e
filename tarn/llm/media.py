"""Media columns: texts as images in tar shards, addressed by content.

Writing: each task turns its texts into 8-bit greyscale PNG images, 192 samples a row, and appends them to a tar shard
in the shared folder, each payload once a shard, under the SHA-256 of its payload. Rows carry digest, shard, offset and
length; payloads never cross a shuffle. A payload that many rows have stands once in each shard whose task met it, so its
rows are dealt as the shards are. Reading: header-only range reads (33 bytes) fill width and height; whole reads give the payload
back for digests and features.

A task that runs again writes a shard of its own name, and its rows point there; the index is cut from its lineage
before anything reads it, so rows and shards agree if an executor is lost later.

Defined results: null and empty texts store one row of 192 spaces; equal texts have equal values; rows are
independent, repeated rows repeat their result; an empty table gives an empty table and no shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, files_at, shared_dir

ROW = 192
#: A shard that has grown beyond so many bytes is closed.
SHARD_BYTES = 128 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = len(SIGNATURE) + 25

INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
READ = "digest string, shard string, offset long, length long, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    height = len(samples) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int]:
    """Width and height from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">II", head[16:24])


def from_png(data: bytes) -> bytes:
    width, height = png_header(data)
    at, body = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + chunk):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only filter type 0 is written")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of an 8 x 8 thumbnail's gradients."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    level = np.arange(256)
    mean = float(share @ level)
    deviation = float(share @ (level - mean) ** 2) ** 0.5
    some = share[share > 0]
    image = x.reshape(-1, ROW)
    image = np.repeat(image, -(-8 // len(image)), axis=0)
    bands = np.add.reduceat(image, np.linspace(0, len(image), 9).astype(int)[:-1], axis=0, dtype=np.int64)  # every sample counts
    sums = np.add.reduceat(bands, np.arange(0, ROW, ROW // 8), axis=1)
    bits = (np.roll(sums, -1, axis=1) > sums).ravel()
    return f"mean={mean:.4f};std={deviation:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};hash={int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


class ShardWriter:
    """Tar shards of one task."""

    def __init__(self, folder: str):
        self.files, self.root = files_at(folder)
        self.files.create_dir(self.root, recursive=True)
        task = TaskContext.get()
        self.name = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "0"
        self.count, self.out = 0, None

    def put(self, digest: str, samples: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.shard = f"shard-{self.name}-{self.count}.tar"
            self.out, self.at, self.held = self.files.open_output_stream(f"{self.root}/{self.shard}"), 0, {}
            self.count += 1
        if digest not in self.held:
            image = to_png(samples)
            entry = tarfile.TarInfo(f"{digest}.png")
            entry.size = len(image)
            head = entry.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + image + bytes(-len(image) % tarfile.BLOCKSIZE))
            self.held[digest] = (self.shard, self.at + len(head), len(image))
            self.at += len(head) + len(image) + -len(image) % tarfile.BLOCKSIZE
        where = self.held[digest]
        if self.at > SHARD_BYTES:
            self.close()
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder)
        for batch in batches:
            size, rows = [], []
            for text in batch.column("text"):
                text = text.as_py()
                samples = payload(text)
                size.append(len((text or "").encode()))
                digest = hashlib.sha256(samples).hexdigest()
                rows.append((digest, *writer.put(digest, samples)))
            digest, shard, offset, length = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        writer.close()

    return write


class ShardReader:
    """Range reads of one task; the last shard stays open."""

    def __init__(self, folder: str):
        self.files, self.root = files_at(folder)
        self.name = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.name, self.opened = shard, self.files.open_input_file(f"{self.root}/{shard}")
        self.opened.seek(offset)
        return self.opened.read(length)


def _headers(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardReader(folder)
        for batch in batches:
            heads = [png_header(shards.read(r["shard"], r["offset"], HEADER_BYTES)) for r in batch.select(["shard", "offset"]).to_pylist()]
            sizes = {name: pa.array([h[i] for h in heads], pa.int64()) for i, name in enumerate(("width", "height"))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | sizes)

    return read


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardReader(folder)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                image = shards.read(r["shard"], r["offset"], r["length"])
                samples = from_png(image)
                if len(samples) != r["width"] * r["height"]:
                    raise ValueError("a stored payload is not as long as its header says")
                rows.append(
                    r
                    | {"payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest()}
                    | {"tail_crc32": zlib.crc32(samples[-16:]), "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(), "feature": feature(samples)}
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return read


def write_media(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Store the texts of `docs`; the index (doc_id, n_bytes, digest, shard, offset, length) and the shards' folder."""
    folder = folder or shared_dir(docs.sparkSession)
    index = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_writer(folder), INDEX))
    return index, folder


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """digest, shard, offset, length, width and height of each stored payload, by header-only range reads in the shards' order."""
    refs = index.select("digest", "shard", "offset", "length").distinct()
    dealt = refs.repartition("shard", (F.col("offset") / (8 << 20)).cast("long")).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(_headers(folder), "digest string, shard string, offset long, length long, width long, height long")


def read_media(index: DataFrame, folder: str) -> DataFrame:
    """Metadata by header-only reads, then digests and features of each stored payload, read back from the shards."""
    return read_headers(index, folder).mapInArrow(_reader(folder), READ)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: its reference, metadata and features."""
    index, folder = write_media(docs)
    found = read_media(index, folder).drop("digest", "length")
    return index.join(found, ["shard", "offset"])
