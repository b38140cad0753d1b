"""Near-duplicate removal on SimHash, completed where 64 bits can't tell.

Texts whose five-word shingles overlap by 0.8 differ in 5 to 17 of 64 fingerprint bits (median 10),
and at such a radius a vantage-point tree prunes nothing. So the tree gives the links within
``radius`` bits, exactly, and the links beyond come from banded min-hashes of the same shingle
hashes: in each band a text is compared with the smallest text of its bucket, then with all others
of the bucket that no link has joined to it yet, in blocks. A link needs a Jaccard similarity of
``similarity`` or more. It is measured on whole shingle sets; only where two texts of over ``SKETCH``
shingles are compared with their bucket's smallest does a bottom-k sketch decide what it puts
``MARGIN`` deviations or more from ``similarity``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_roots
from .shared import small_batches, written
from .simhash import SEED, fingerprint_links

BANDS, ROWS, SKETCH = 16, 4, 512
#: Deviations of a sketch's estimate within which whole sets decide.
MARGIN = 6
BUCKETS = 1 << 18
#: Texts of a block: two blocks of whole shingle sets are compared in memory.
BLOCK = 128
#: Odd multipliers of the min-hash permutations.
FACTORS = np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a text of fewer words has one, a text of none has none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][:n].tolist()
    h64 = xxhash.xxh64_intdigest
    return np.array([h64(joined[i:j], SEED) for i, j in zip(begins, ends[min(width, len(words)) - 1 :].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[k : k + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def bands(hashes: np.ndarray) -> list[int]:
    """One hash for each band of min-hashes."""
    if not len(hashes):
        return []
    x = np.unique(hashes)
    low = np.array([((x * f) ^ ((x * f) >> np.uint64(31))).min() for f in FACTORS], np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ low[:, k]) * BAND_FACTOR
        out ^= out >> np.uint64(29)
    return out.view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """From two bottom-k sketches: of the smallest SKETCH of the union, the share in both."""
    union = np.union1d(a, b)[:SKETCH]
    return float((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).sum() / max(1, len(union)))


def similar(x: list[np.ndarray], y: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``similarity`` or more between whole shingle sets ``x`` and ``y``, or within ``x``."""
    other = x if y is None else y
    _, ids = np.unique(np.concatenate(x + (y or [])), return_inverse=True)
    sizes, n = np.array([len(s) for s in other]), sum(map(len, x))
    theirs = ids if y is None else ids[n:]
    starts, marked = np.r_[0, np.cumsum(sizes)[:-1]], np.zeros(ids.max() + 1, bool)
    found, at = [], 0
    for k, s in enumerate(x):
        mine = ids[at : at + len(s)]
        at += len(s)
        marked[mine] = True
        both = np.add.reduceat(marked[theirs], starts, dtype=np.int64)
        marked[mine] = False
        hits = np.flatnonzero(both / (len(s) + sizes - both) >= similarity)
        hits = hits[hits > k] if y is None else hits
        found.append((np.full(len(hits), k), hits))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def rest_links(each: DataFrame, joined: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links between texts of one bucket that are not ``joined`` yet: every pair of them is compared.

    A group of ``BLOCK`` texts and more has blocks of its own, which aren't compared with each
    other; the smaller groups of a bucket share blocks. None where every bucket is one group.
    """
    rooted = each.join(joined.select(F.col("node").alias("digest"), "root"), "digest", "left").select("band", "digest", F.coalesce("root", "digest").alias("root"))
    groups = written(rooted.groupBy("band", "root").agg(F.count("*").alias("n")), "bucket-groups")
    mixed = groups.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    part = F.when(F.col("n") >= BLOCK, F.col("root"))
    groups = groups.join(mixed, "band", "left_semi").select("band", "root", "n", part.alias("part"))
    parts = groups.groupBy("band", "part").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    parts = written(parts.select(F.col("band").alias("in"), F.col("part").alias("of"), "blocks"), "bucket-parts")
    if parts.isEmpty():
        return None
    label = F.xxhash64(F.col("of").isNull(), "of", "k").alias("label")
    labels = written(parts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(F.col("in").alias("band"), "of", label), "blocks")
    x, y = labels.select("band", F.col("of").alias("p"), F.col("label").alias("x")), labels.select("band", F.col("of").alias("q"), F.col("label").alias("y"))
    pairs = x.join(y, "band").where("x <= y and (p is null or q is null or p <> q)").select("band", "x", "y", F.xxhash64("band", "x", "y").alias("task"))
    sides = written(pairs.select("band", F.explode(F.array(F.struct("task", F.col("x").alias("label"), F.lit(0).alias("side")), F.struct("task", F.col("y").alias("label"), F.when(F.col("x") < F.col("y"), 1).alias("side")))).alias("s")).select("band", "s.*").where("side is not null"), "sides")
    at = F.col("band").eqNullSafe(F.col("in")) & F.col("part").eqNullSafe(F.col("of"))
    members = rooted.join(groups.select("band", "root", "part"), ["band", "root"]).join(parts, at)
    members = members.withColumn("k", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("blocks"))).select("band", "digest", label)
    loaded = members.join(sides, ["band", "label"]).select("task", "side", "digest").join(sets, "digest").select("task", "side", "digest", "hashes")

    def compare(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        digests, n = t["digest"].to_numpy()[order], int((side == 0).sum())
        hashes = t["hashes"].to_pylist()
        data = [np.frombuffer(hashes[i], np.uint64) for i in order]
        none = np.zeros(0, np.int64)
        if n == 0 or (len(data) > n) != bool(side.any()):
            a = b = none
        elif len(data) > n:
            a, b = similar(data[:n], data[n:], similarity)
            b = b + n
        else:
            a, b = similar(data, None, similarity)
        # as many links as texts: each one's to the first of its group
        root = local_roots(len(digests), a, b)
        moved = np.flatnonzero(root != np.arange(len(digests)))
        return pa.table({"a": pa.array(digests[moved], pa.int64()), "b": pa.array(digests[root[moved]], pa.int64())})

    return loaded.groupBy("task").applyInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, *, text: str = "text", width: int = 5, radius: int = 2, similarity: float = 0.8) -> DataFrame:
    """``digest, root``: the group of each distinct text that is not its group's first.

    Whole texts are read, however long; null counts as empty, and texts without words are one group
    by their fingerprint. Repeated rows count once. Empty in, empty out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    raw = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t")).withColumn("digest", F.xxhash64("t"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, width) for t in b[1].to_pylist()]
            fp = np.array([simhash(h) for h in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(fp), pa.array([bands(h) for h in hashes], pa.list_(pa.int64()))], ["digest", "fp", "bands"])

    marks = written(raw.select("digest", "t").mapInArrow(mark, "digest long, fp long, bands array<long>").groupBy("digest").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")), "marks")
    # within the radius: fingerprints are linked, and a fingerprint's texts with its smallest
    same = written(marks.groupBy("fp").agg(F.min("digest").alias("first")), "by-fingerprint")
    close = fingerprint_links(same.select("fp"), radius)
    one, other = same.select(F.col("fp").alias("a"), F.col("first").alias("x")), same.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    links = written(close.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b")), "tree-links")
    equal = marks.join(same, "fp").where("digest <> first").select(F.col("digest").alias("a"), F.col("first").alias("b"))
    # beyond it: each band's bucket is a star around its smallest text
    each = written(marks.select("digest", F.explode("bands").alias("band")), "bands")
    stars = written(each.groupBy("band").agg(F.min("digest").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "stars")
    pairs = written(each.join(stars, "band").where("digest <> first").select(F.col("digest").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("bucket")
    near = F.broadcast(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).select(bucket).distinct())

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.unique(shingle_hashes(t, width)).tobytes() for t in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(out, pa.binary())], ["digest", "hashes"])

    some = raw.withColumn("bucket", bucket).join(near, "bucket", "left_semi").select("digest", "t")
    sets = written(some.mapInArrow(shingles, "digest long, hashes binary").groupBy("digest").agg(F.first("hashes").alias("hashes")), "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b[2].to_pylist(), b[3].to_pylist())]
            share = np.array([jaccard(x, y) for x, y in both])
            whole = np.array([len(x) < SKETCH and len(y) < SKETCH for x, y in both], bool)
            sure = whole | (np.abs(share - similarity) >= MARGIN * (similarity * (1 - similarity) / SKETCH) ** 0.5)
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(sure)], ["a", "b", "sure"]).filter(pa.array(~sure | (share >= similarity)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [len(similar([np.frombuffer(x, np.uint64)], [np.frombuffer(y, np.uint64)], similarity)[0]) > 0 for x, y in zip(b[2].to_pylist(), b[3].to_pylist())]
            yield pa.RecordBatch.from_arrays([b[0], b[1]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def beside(links: DataFrame, column: str) -> DataFrame:
        left, right = (sets.select(F.col("digest").alias(k), F.expr(column).alias(f"of_{k}")) for k in "ab")
        return links.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")

    seen = written(beside(pairs, f"substring(hashes, 1, {8 * SKETCH})").mapInArrow(verify, "a long, b long, sure boolean"), "measured")
    wide = seen.where("sure").select("a", "b").union(beside(seen.where("not sure").select("a", "b"), "hashes").mapInArrow(measure, "a long, b long"))
    joined = written(components(written(links.unionByName(equal).unionByName(wide), "near-links")), "joined")
    rest = rest_links(each, joined, sets, similarity)
    if rest is not None:
        joined = components(written(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest), "all-links"))
    return joined.select(F.col("node").alias("digest"), "root")


def without_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id's, columns as they were.

    Ids tie by the text's digest; of equal rows one stays; a null id gives way to any other. Null
    and empty texts are copies of each other. An empty table stays empty.
    """
    groups = written(near_groups(docs, text=text, **options), "groups")
    # the caller's row stands in a struct, so that no name can clash
    mine = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("digest"), F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("id"))
    # by text first, then by group: a text of a third of all rows is one row after the first step
    texts = mine.groupBy("digest").agg(F.min("id").alias("low"))
    rooted = texts.join(groups, "digest", "left").select("digest", "low", F.coalesce("root", "digest").alias("root"))
    keep = written(rooted.groupBy("root").agg(F.min(F.struct("low", "digest")).alias("k")).select(F.col("k.low").alias("id"), "k.digest"), "keepers")
    return mine.join(keep, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
