"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage-point trees.

Distinct fingerprints are dealt to shards by a vantage-point tree over Hamming distance, built on
a bounded sample. A fingerprint goes to the side of the ball it lies in, and one within the radius
inside the boundary goes outside as well, so that any pair within the radius meets in a shard: two
on one side go down together; of two on different sides the inner one, by the triangle inequality,
lies within the radius of the boundary. In its shard the same tree, now over all fingerprints
there, prunes until leaves are small enough to compare. A shard gives a forest of its links, and
the components of all shards' links are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_roots
from .shared import small_batches, written

#: Fingerprints of the sample that the shards' tree is built on: 64 for each shard, within these bounds.
SAMPLE, MOST = 20_000, 1_000_000
#: Distinct fingerprints that a shard should hold (it may hold more).
SHARD = 32_768
#: Fingerprints that are compared pair by pair.
LEAF = 512
SEED = 42


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of a text's shingles of ``width`` words, A-Z in lower case; no word: 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    h64, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 100_000):
        hashes = np.array([h64(joined[i:j], seed) for i, j in zip(begins[k : k + 100_000], ends[k : k + 100_000])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every whole text; null counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b[1].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(fp, pa.int64())], ["doc_id", "fp"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def boundary(dist: np.ndarray, radius: int) -> int | None:
    """The ball that splits best, None if none makes both sides smaller than the whole."""
    count = np.bincount(dist, minlength=66)
    inside = np.cumsum(count)
    overlap = inside - np.r_[np.zeros(radius, np.int64), inside[:-radius]][: len(inside)]
    larger = np.maximum(inside, len(dist) - inside + overlap)
    best = int(np.argmin(larger))
    return best if larger[best] < 0.95 * len(dist) else None


def sides(fp: np.ndarray, vantage: np.uint64, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = hamming(fp, vantage)
    return d <= mu, d > mu - radius


def shard_tree(sample: np.ndarray, total: int, radius: int) -> tuple | int:
    """Nested (vantage, ball, inner, outer); leaves are shard numbers."""
    numbers = iter(range(1 << 30))
    share = max(1, len(sample)) / max(1, total)

    def grow(fp: np.ndarray, depth: int):
        if len(fp) > max(64, SHARD * share) and depth < 24:
            v = fp[len(fp) // 2]
            mu = boundary(hamming(fp, v), radius)
            if mu is not None:
                a, b = sides(fp, v, mu, radius)
                return int(v), mu, grow(fp[a], depth + 1), grow(fp[b], depth + 1)
        return next(numbers)

    return grow(sample, 0)


def deal(tree, fp: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    if isinstance(tree, int):
        yield tree, fp
    elif len(fp):
        v, mu, inner, outer = tree
        a, b = sides(fp, np.uint64(v), mu, radius)
        yield from deal(inner, fp[a], radius)
        yield from deal(outer, fp[b], radius)


def near_links(fp: np.ndarray, radius: int, depth: int = 0, banded: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that span every component of ``fp`` within ``radius`` (distinct values).

    What no ball splits goes by bands of bits: two within ``radius`` agree in one of radius + 1.
    """
    if len(fp) < 2:
        return
    mu = v = None
    if len(fp) > LEAF and depth < 60:
        for k in (len(fp) // 2, 0, len(fp) - 1):
            v = fp[k]
            if (mu := boundary(hamming(fp, v), radius)) is not None:
                break
    if mu is not None:
        a, b = sides(fp, v, mu, radius)
        yield from near_links(fp[a], radius, depth + 1, banded)
        yield from near_links(fp[b], radius, depth + 1, banded)
        return
    if len(fp) > 4 * LEAF and not banded:
        cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
        for low, high in zip(cuts, cuts[1:]):
            band = (fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            order = np.argsort(band, kind="stable")
            for part in np.split(fp[order], np.flatnonzero(np.diff(band[order])) + 1):
                yield from near_links(part, radius, depth + 1, True)
        return
    i, j = [], []
    for k in range(0, len(fp), LEAF):  # one block of rows against all after it
        rows, cols = np.nonzero(hamming(fp[k : k + LEAF, None], fp[None, k:]) <= radius)
        later = cols > rows
        rows, cols = rows[later] + k, cols[later] + k
        if len(rows):
            i.append(rows)
            j.append(cols)
        if sum(map(len, i)) > 4_000_000 or k + LEAF >= len(fp) and i:  # a forest stands for them
            root = local_roots(len(fp), np.concatenate(i), np.concatenate(j))
            moved = np.flatnonzero(root != np.arange(len(fp)))
            i, j = [moved], [root[moved]]
    if i:
        yield fp[i[0]], fp[j[0]]


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that span their components."""
    total = distinct.count()
    sample = min(MOST, max(SAMPLE, 64 * (total // SHARD)))
    chosen = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30))).limit(2 * sample)
    tree = shard_tree(np.array([r.fp for r in chosen.collect()], np.int64).view(np.uint64), total, radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, fp in deal(tree, b[0].to_numpy().view(np.uint64), radius):
                if len(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), shard)), pa.array(fp.view(np.int64))], ["shard", "fp"])

    def within(table: pa.Table) -> pa.Table:
        fp = np.sort(table["fp"].to_numpy().view(np.uint64))
        found = list(near_links(fp, radius))
        if not found:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = (np.searchsorted(fp, np.concatenate(x)) for x in zip(*found))
        root = local_roots(len(fp), a, b)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})

    return distinct.select("fp").mapInArrow(spread, "shard long, fp long").groupBy("shard").applyInArrow(within, "a long, b long")


def simhash_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint every whole text and join those within ``radius`` bits into components.

    Returns ``doc_id, fingerprint, component_id`` (the smallest id reachable), a row for each input
    row, repeated rows included. A null text counts as empty; texts without words have fingerprint
    zero and link like any other; a row with a null id keeps it, and its component's smallest id is
    that of the others, null if none has one. Other columns aren't read; empty in, empty out.
    """
    marks = written(fingerprints(docs, doc_id=doc_id, text=text, width=width), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct, radius))
    placed = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    named = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    by_fp = written(placed.join(named, "root").select("fp", "component_id"), "by_fp")
    return marks.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
