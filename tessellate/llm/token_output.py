"""Token-id output: binary shards whose document boundaries are Elias-Fano encoded.

A shard file holds, little-endian: a header (magic, version, id width, documents, ids, documents
without an id, the first document id, the span of document ids), two Elias-Fano sequences and last
the concatenated token ids. The sequences are the running count of ids after each document, and the
ascending document ids less the first. Each is its low bits (packed), its high bits (unary bitmap)
and a select index (the position of every 64th set bit). The i-th value is read back with select:
``((position of the i-th set bit - i) << low) | low bits``. This takes about ``2 + log2(span /
documents)`` bits a document where a table takes 64. A reader asks for the bytes of the documents it
wants alone: its memory doesn't grow with the shard.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, shuffle_width, small_batches, written

MAGIC, HEADER = b"TIDS", struct.Struct("<4sHHqqqqQ")
#: Every SAMPLE-th set bit of the high part has its position stored.
SAMPLE = 64
#: Stands for a null document id.
NONE = -(2**63)
#: Documents that a reader takes at a time.
READ_DOCS = 4096
#: Token ids that a reader takes at a time, unless one document has more.
READ_IDS = 1 << 21
#: Chunks and words that a worker remembers.
CACHE = 500_000
#: Bytes of texts whose new chunks are learned together.
HELD = 4 << 20


class EliasFano:
    """A non-decreasing sequence in near-minimal space, with select. ``read(begin, size)`` gives its bytes."""

    def __init__(self, n: int, top: int, read: Callable[[int, int], bytes]):
        self.n, self.read = n, read
        self.low_bits, self.low_bytes, self.high_bytes, marks = self.shape(n, top)
        self.size = self.low_bytes + self.high_bytes + 8 * marks

    @staticmethod
    def shape(n: int, top: int) -> tuple[int, int, int, int]:
        """Low bits, bytes of the low part, bytes of the high part, entries of the select index."""
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        return bits, (n * bits + 7) // 8, (n + (top >> bits) + 1 + 7) // 8, (n + SAMPLE - 1) // SAMPLE

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        """The last value is the span that a reader must know."""
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits, _, high_bytes, _ = cls.shape(n, top)
        # whole bytes at a time: 8192 values of any number of bits
        low = [np.packbits(((values[k : k + 8192, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for k in range(0, n, 8192)]
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(high_bytes * 8, np.uint8)
        high[at] = 1
        return b"".join(low) + np.packbits(high, bitorder="little").tobytes() + at[::SAMPLE].astype("<u8").tobytes()

    def select(self, begin: int, end: int) -> np.ndarray:
        """Values ``begin`` to ``end``: a few entries of the index, and the bytes between them."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        first, last = begin // SAMPLE, (end - 1) // SAMPLE
        marks = np.frombuffer(self.read(self.low_bytes + self.high_bytes + 8 * first, 8 * (min(last + 2, -(-self.n // SAMPLE)) - first)), "<u8").astype(np.int64)
        stop = int(marks[last + 1 - first]) // 8 + 1 if last + 1 - first < len(marks) else self.high_bytes
        byte = int(marks[0]) // 8
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.read(self.low_bytes + byte, stop - byte), np.uint8), bitorder="little")) + 8 * byte
        ones = ones[ones >= marks[0]][begin - first * SAMPLE :][: end - begin]
        bits, at = self.low_bits, begin * self.low_bits // 8
        raw = np.unpackbits(np.frombuffer(self.read(at, (end * bits + 7) // 8 - at), np.uint8), bitorder="little")
        low = raw[begin * bits - 8 * at :][: (end - begin) * bits].reshape(end - begin, bits).astype(np.uint64)
        return ((ones - np.arange(begin, end)).astype(np.uint64) << np.uint64(bits)) | (low << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def get(self, i: int) -> int:
        return int(self.select(i, i + 1)[0])


def pack(doc_ids: np.ndarray, ends: np.ndarray, ids: bytes, width: int) -> list[bytes]:
    """The parts of a shard file. ``doc_ids`` ascend, the least long for none; ``ends``: the running count of ids."""
    doc_ids = np.asarray(doc_ids, np.int64)
    nameless = int(np.searchsorted(doc_ids, NONE, "right"))
    named = doc_ids[nameless:].view(np.uint64)
    offsets = named - named[:1]
    head = HEADER.pack(MAGIC, 2, width, len(doc_ids), len(ids) // width, nameless, int(doc_ids[nameless]) if len(named) else 0, int(offsets[-1]) if len(named) else 0)
    return [head, EliasFano.encode(ends), EliasFano.encode(offsets), ids]


class TokenShard:
    """A shard file's documents, by ranged reads of ``file`` (anything with ``seek`` and ``read``)."""

    def __init__(self, file):
        self.file = file
        magic, version, self.width, self.n, total, self.nameless, self.first, span = HEADER.unpack(self.bytes(0, HEADER.size))
        if magic != MAGIC or version != 2:
            raise ValueError("not a shard of token ids")
        self.ends = EliasFano(self.n, total, lambda at, size: self.bytes(HEADER.size + at, size))
        begin = HEADER.size + self.ends.size
        self.named = EliasFano(self.n - self.nameless, span, lambda at, size: self.bytes(begin + at, size))
        self.ids_at = begin + self.named.size

    def bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def doc_ids(self, begin: int, end: int) -> np.ndarray:
        """Ids of documents ``begin`` to ``end``, the least long for none."""
        named = self.named.select(max(begin - self.nameless, 0), max(end - self.nameless, 0)) + np.int64(self.first).view(np.uint64)
        return np.r_[np.full(end - begin - len(named), NONE), named.view(np.int64)]

    def bounds(self, begin: int, end: int) -> np.ndarray:
        """Where documents ``begin`` to ``end`` start, and where the last ends."""
        ends = self.ends.select(max(begin - 1, 0), end).astype(np.int64)
        return ends if begin else np.r_[0, ends]

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Token ids ``begin`` to ``end`` of the shard."""
        return np.frombuffer(self.bytes(self.ids_at + begin * self.width, (end - begin) * self.width), "<u2" if self.width == 2 else "<u4")


class Encoder:
    """Ids of white-space-separated chunks through the tokenizers library, each chunk once.

    The vocabulary drops white space, so that a text's ids are those of its chunks in order. A
    chunk's normal form and its BPE come from the library's own normalizer and model.
    """

    #: The vocabulary's pattern, and a space as the mark between chunks.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+| "

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        from .token_counts import byte_symbols

        self.lib = Tokenizer.from_file(path)
        self.find = regex.compile(self.WORDS).findall
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.table = {i: c for i, c in enumerate(byte_symbols())}
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def ids(self, ids: list[int]) -> bytes:
        x = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            x.byteswap()
        return x.tobytes()

    def learn_words(self, words: set[str]) -> None:
        if len(self.words) > CACHE:
            self.words.clear()
        tokenize = self.lib.model.tokenize
        for w in words.difference(self.words):
            plain = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.table)
            self.words[w] = self.ids([t.id for t in tokenize(plain)])

    def learn(self, chunks: list[bytes]) -> None:
        """All chunks in one pass: normalised together, cut together, each word once."""
        text = b" ".join(chunks).decode()
        if len(chunks) > 1 and (any(x in text for x in self.special) or text.split() != text.split(" ")):
            for c in chunks:  # a special string or other white space within: one by one
                self.learn([c])
            return
        if any(x in text for x in self.special):
            self.chunks[chunks[0]] = self.ids(self.lib.encode(text, add_special_tokens=False).ids)
            return
        found = self.find(text.lower() if text.isascii() else self.lib.normalizer.normalize_str(text))
        self.learn_words({w for w in found if w != " "})
        words = self.words
        if len(chunks) == 1:
            self.chunks[chunks[0]] = b"".join([words[w] for w in found if w != " "])
            return
        out, run = [], b""
        for w in found:
            if w == " ":
                out.append(run)
                run = b""
            else:
                run += words[w]
        out.append(run)
        self.chunks.update(zip(chunks, out, strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. Texts are taken together up to HELD bytes."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= HELD):
                size += len(texts[end])
                end += 1
            lists = [t.split() for t in texts[at:end]]
            if len(self.chunks) > CACHE:
                self.chunks.clear()
            new = set().union(*lists).difference(self.chunks)
            if new:
                self.learn(list(new))
            get = self.chunks.__getitem__
            out.extend(b"".join(map(get, x)) for x in lists)
            at = end
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def filesystem(path: str):
    """pyarrow's file system and the path within it, for file:, s3:, gs:, hdfs: and the like."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


#: Documents and bytes of ids after which a shard file ends.
SHARD_DOCS, SHARD_BYTES = 1_000_000, 128 << 20


def write_token_shards(docs: DataFrame, vocabulary: str, *, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards in ascending ``doc_id`` order.

    Returns the manifest, written too: ``path, part, piece, n_docs, n_ids``, in whose (part, piece)
    order the ids of all shards form one array. Null texts are empty documents (the end id alone);
    null ids sort first and are stored as the smallest long; of equal ids the order is by text.
    A task that runs again writes under another name: only what the manifest names counts.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = enc.ids([end_id])
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        ids, held, sizes, rows, piece = [], 0, [], [], 0

        def flush():
            nonlocal ids, held, sizes, rows, piece
            name = f"part-{part:06d}-{piece:04d}-{uuid.uuid4().hex}.tids"
            ends = np.cumsum(np.array(sizes, np.int64))
            with store.open_output_stream(f"{root}/{name}") as out:
                for x in pack(np.array(rows, np.int64), ends, b"".join(ids), enc.width):
                    out.write(x)
            row = pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "part": part, "piece": piece, "n_docs": len(rows), "n_ids": int(ends[-1])}])
            ids, held, sizes, rows, piece = [], 0, [], [], piece + 1
            return row

        for b in batches:
            for i, x in zip(b[0].to_pylist(), enc.encode(b[1].to_pylist())):
                x += end
                ids.append(x)
                sizes.append(len(x) // enc.width)
                rows.append(i)
                held += len(x)
                if len(rows) >= SHARD_DOCS or held >= SHARD_BYTES:
                    yield flush()
        if rows:
            yield flush()

    n = partitions or shuffle_width(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NONE)).alias("i"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    # ids alone could hold one frequent value: a digest of the text spreads repeated ids
    key = ["i", F.xxhash64("t")]
    ordered = slim.repartitionByRange(n, *key).sortWithinPartitions(*key, "t")
    return written(ordered.mapInArrow(run, "path string, part long, piece long, n_docs long, n_ids long"), "manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Read shards back: ``doc_id, start, n_tokens, ids_crc32`` for each document.

    ``start`` counts the ids of all documents before it, over all shards. The manifest has a row
    for each shard, which the driver may hold: shards number with the tasks, not the documents.
    """
    spark = manifest.sparkSession
    shards = sorted(manifest.collect(), key=lambda r: (r.part, r.piece))
    starts = np.cumsum([0, *(r.n_ids for r in shards)])
    rows = [(r.path, int(s)) for r, s in zip(shards, starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b[0].to_pylist(), b[1].to_pylist()):
                store, name = filesystem(path)
                with store.open_input_file(name) as f:
                    shard = TokenShard(f)
                    for k in range(0, shard.n, READ_DOCS):
                        docs, at = shard.doc_ids(k, min(shard.n, k + READ_DOCS)), shard.bounds(k, min(shard.n, k + READ_DOCS))
                        crc, done = [], 0
                        while done < len(docs):
                            # as many documents as READ_IDS hold, one at least
                            upto = max(done + 1, int(np.searchsorted(at, at[done] + READ_IDS, "right")) - 1)
                            wide = shard.ids(int(at[done]), int(at[upto])).astype("<u4")
                            cut = (at[done : upto + 1] - at[done]).tolist()
                            crc += [zlib.crc32(wide[x:y]) for x, y in zip(cut, cut[1:])]
                            done = upto
                        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NONE), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, start long")
    # a few shards a task
    return listed.repartition(max(1, min(len(rows), 10_000)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str, *, end_id: int = 2, **columns: str) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and return what is read back from them."""
    spark: SparkSession = docs.sparkSession
    return read_token_shards(write_token_shards(docs, vocabulary, end_id=end_id, folder=fresh_path(spark, "tids"), **columns))
