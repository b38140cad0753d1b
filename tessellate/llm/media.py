"""Media columns: content-addressed payloads in tar shards, rows that point into them.

A payload is stored once a task, as a grey 8-bit PNG of 64 samples a row, under its SHA-256, in a tar file
of the shared folder. The index has digest, shard, offset and length. Metadata columns come from
range reads of the header alone; samples and features from reads of the stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, shuffle_width, small_batches, written
from .token_output import filesystem

WIDTH = 64
#: Bytes after which a tar shard ends, and bytes of a stored form that hold all metadata.
SHARD_BYTES, HEADER_BYTES = 256 << 20, 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Compression of the stored form.
LEVEL = 6


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Grey 8-bit image, WIDTH samples a row, filter 0 throughout."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def header(first: bytes) -> dict:
    """Metadata from a stored form's first HEADER_BYTES."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", first[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour": colour}


def from_png(media: bytes) -> bytes:
    """The samples of what ``to_png`` wrote; its checksums are verified."""
    meta, at, parts = header(media), 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(media[at + 4 : at + 8 + size]) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("a filter is used")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples and the mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    level = np.arange(256)
    mean = float((p * level).sum())
    deviation = float(np.sqrt(max(0.0, (p * level * level).sum() - mean * mean)))
    p = p[p > 0]
    step = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


def payloads(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n_bytes, payload``: UTF-8 bytes of every whole text, zeros up to a positive multiple of 64."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t")).withColumn("n_bytes", F.octet_length("t").cast("long"))
    pad = F.when(F.col("n_bytes") == 0, 64).otherwise(F.pmod(-F.col("n_bytes"), F.lit(64))).cast("int")
    return raw.select("doc_id", "n_bytes", F.concat("t", F.unhex(F.repeat(F.lit("00"), pad))).alias("payload"))


def store_media(docs: DataFrame, *, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write payloads to tar shards; returns the index ``digest, shard, begin, length``, a row a digest.

    Each task stores a payload once, however many of its rows share it, so that no payload is
    shuffled; of a payload that several tasks have stored, the index names one place.
    """
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, out, name, at = set(), None, "", 0
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)

        def close():
            nonlocal out
            out.write(b"\0" * 1024)
            out.close()
            out = None

        for b in batches:
            rows = []
            for key, payload in zip(b[0].to_pylist(), b[1].to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                if out is None:  # a task that runs again writes under another name
                    name, at = f"media-{uuid.uuid4().hex}.tar", 0
                    out = store.open_output_stream(f"{root}/{name}")
                media = to_png(payload)
                info = tarfile.TarInfo(f"{key.hex()}.png")
                info.size = len(media)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + media + b"\0" * (-len(media) % 512))
                rows.append({"digest": key, "shard": f"{folder}/{name}", "begin": at + len(head), "length": len(media)})
                at += len(head) + len(media) + -len(media) % 512
                if at >= SHARD_BYTES:
                    close()
            if rows:
                yield pa.RecordBatch.from_pylist(rows)
        if out is not None:
            close()

    marked = payloads(docs, doc_id, text).select(_digest().alias("digest"), "payload")
    places = written(marked.mapInArrow(write, "digest binary, shard string, begin long, length long"), "media-places")
    one = places.groupBy("digest").agg(F.min(F.struct("shard", "begin", "length")).alias("at"))
    return written(one.select("digest", "at.*"), "media-index")


def _digest():
    return F.unhex(F.sha2("payload", 256))


def media_columns(index: DataFrame) -> DataFrame:
    """Metadata by header-only range reads: ``index`` with ``width, height, bit_depth``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meta = []
            for row in b.to_pylist():
                store, name = filesystem(row["shard"])
                with store.open_input_file(name) as f:
                    meta.append(header(f.read_at(HEADER_BYTES, row["begin"])))
            extra = [pa.array([m[k] for m in meta], pa.int64()) for k in ("width", "height", "bit_depth")]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "width", "height", "bit_depth"])

    kinds = ", ".join(f"{k} {v}" for k, v in index.dtypes)
    return index.mapInArrow(read, f"{kinds}, width long, height long, bit_depth long")


def media_features(index: DataFrame) -> DataFrame:
    """``index`` with what is read back: ``payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height``.

    The header's range read gives width and height, the whole range the rest. Each shard is read by
    one task, in the order of its places.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, f = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["shard"] != shard:
                    if f:
                        f.close()
                    shard = row["shard"]
                    store, name = filesystem(shard)
                    f = store.open_input_file(name)
                meta = header(f.read_at(HEADER_BYTES, row["begin"]))
                media = f.read_at(row["length"], row["begin"])
                payload = from_png(media)
                out.append({
                    **row, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
                    "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload), "width": meta["width"], "height": meta["height"],
                })
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if f:
            f.close()

    # a set number of partitions: the index is so small that its tasks would be merged into one
    ordered = index.repartition(shuffle_width(index.sparkSession), "shard").sortWithinPartitions("shard", "begin")
    return ordered.mapInArrow(read, "digest binary, shard string, begin long, length long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def media_table(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Store every whole text and return a row for each input row with its media columns.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, width, height, shard, begin, length``. A null or empty text is 64 zero bytes. Equal
    texts share one stored form and have equal values; repeated rows and null ids stay. Other
    columns aren't read; an empty table stores nothing.
    """
    index = store_media(docs, folder=folder or fresh_path(docs.sparkSession, "media"), doc_id=doc_id, text=text)
    found = written(media_features(index), "media")
    rows = payloads(docs, doc_id, text).select("doc_id", "n_bytes", _digest().alias("digest"))
    return rows.join(found, "digest").drop("digest")
