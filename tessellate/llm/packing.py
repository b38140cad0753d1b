"""Best-fit packing into bins of several permitted lengths.

Texts become items of their token count; those longer than the longest bin are cut into pieces.
Items are dealt to shards of bounded size by a digest of what they are, and each shard is packed by
best-fit decreasing. An item that no open bin holds opens one, and every permitted length is tried
for it: filled with the items that are left, longest first, each gives a cost a token, of the
length its contents would shrink to and the overhead. The least opens. Last, each bin shrinks to
the smallest length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .token_counts import token_counts

SIZES = (512, 1024, 2048, 4096, 8192)
#: What a bin costs besides its length.
OVERHEAD = 16
#: Items that a shard has on average.
SHARD_ITEMS = 50_000
#: Equal rows that one task deals out.
CHUNK = 10_000


def opening(n: int, sizes: tuple[int, ...], overhead: int, left: int, count: list[int]) -> int:
    """The length to open for an item of ``n`` tokens. ``left`` has a bit for each length of ``count``, the items that are left."""
    best, choice = None, sizes[-1]
    for size in sizes:
        if size < n:
            continue
        room, below = size - n, left
        # longest first, as many as are left and fit
        while room and (below := below & ((2 << room) - 1)):
            top = below.bit_length() - 1
            room -= top * min(count[top], room // top)
            below &= ~(1 << top)
        fill = size - room
        cost = (sizes[bisect_left(sizes, fill)] + overhead) / fill
        if best is None or cost < best:
            best, choice = cost, size
    return choice


def best_fit(lengths: list[int], sizes: tuple[int, ...], overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item (longest first), and each bin's fill and capacity.

    ``room`` has a bit for each free space that some open bin has: the lowest bit at or above an
    item's length is its best fit.
    """
    where, fill, capacity = [], [], []
    room, open_ = 0, {}
    left, count = 0, [0] * (sizes[-1] + 1)
    for n in lengths:
        count[n] += 1
        left |= 1 << n
    for n in lengths:
        count[n] -= 1
        if not count[n]:
            left &= ~(1 << n)
        if over := room >> n:
            free = n + ((over & -over).bit_length() - 1)
            b = open_[free].pop()
            if not open_[free]:
                room &= ~(1 << free)
        else:
            free = opening(n, sizes, overhead, left, count)
            b = len(fill)
            fill.append(0)
            capacity.append(free)
        where.append(b)
        fill[b] += n
        if free > n:
            open_.setdefault(free - n, []).append(b)
            room |= 1 << (free - n)
    return where, fill, capacity


def pack(lengths: np.ndarray, sizes: tuple[int, ...], overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its bin and offset; for each bin its final length. Items are of one token at least."""
    order = np.argsort(-lengths, kind="stable")
    items = lengths[order].tolist()
    where, fill, _ = best_fit(items, sizes, overhead)
    final = np.array(sizes)[np.searchsorted(sizes, fill)] if fill else np.zeros(0, np.int64)
    bins, offset = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
    at = [0] * len(final)
    for i, b, n in zip(order.tolist(), where, items):
        bins[i], offset[i] = b, at[b]
        at[b] += n
    return bins, offset, final


def pieces(counts: DataFrame, longest: int) -> DataFrame:
    """``doc_id, n_tokens, copy`` cut into items ``doc_id, copy, piece, begin, n_tokens``; none for no token."""
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / longest).cast("long")))
    cut = counts.where("n_tokens > 0").withColumn("piece", number)
    begin = F.col("piece") * longest
    return cut.select("doc_id", "copy", "piece", begin.alias("begin"), F.least(F.lit(longest).cast("long"), F.col("n_tokens") - begin).alias("n_tokens"))


def packed(counts: DataFrame, *, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Pack ``counts`` (``doc_id, n_tokens``) into bins.

    Returns ``doc_id, piece, begin, n_tokens, bin, bin_size, offset``: tokens ``begin`` to ``begin +
    n_tokens`` of the document stand at ``offset`` of the bin. All tokens of all rows are packed
    once. Rows of null or no tokens have no item; null and repeated ids are packed like others.
    A shard is chosen by id, tokens, piece and the number of the copy among equal rows, so that no
    id is a hot one and reruns agree however the rows are split into files. Empty in, empty out.
    """
    sizes = tuple(sorted(sizes))
    # equal rows are counted, and dealt out again in chunks
    same = counts.where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies"))
    each = lambda begin, end: F.explode(F.sequence(begin, end))
    chunks = written(same.withColumn("chunk", each(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK).cast("long"))), "pack-rows")
    first = F.col("chunk") * CHUNK
    rows = chunks.withColumn("copy", each(first, F.least(first + CHUNK, F.col("copies")) - 1))
    items = pieces(rows, sizes[-1])
    many = chunks.agg(F.sum(F.least(F.lit(CHUNK).cast("long"), F.col("copies") - first) * F.ceil(F.col("n_tokens") / sizes[-1]))).first()[0] or 0
    shards = -(-int(many) // shard_items) or 1

    def run(table: pa.Table) -> pa.Table:
        # by length, then id, so that reruns agree whatever order the rows come in
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        bins, offset, final = pack(table["n_tokens"].to_numpy(), sizes, overhead)
        first = table["shard"][0].as_py() << 32
        return pa.table({**{k: table[k] for k in ("doc_id", "piece", "begin", "n_tokens")}, "bin": pa.array(bins + first), "bin_size": pa.array(final[bins], pa.int64()), "offset": pa.array(offset)})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "piece", "copy"), F.lit(shards)))
    kind = counts.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece long, begin long, n_tokens long, bin long, bin_size long, offset long")


def packed_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Count every whole text's tokens and pack them."""
    return packed(token_counts(docs, vocabulary).select("doc_id", "n_tokens"), **options)


__all__ = ["packed", "packed_documents", "pack", "best_fit", "pieces"]
