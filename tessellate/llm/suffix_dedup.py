"""Suffix-array deduplication: remove every byte of a long string that stands elsewhere too.

Suffixes are compared through prefix polynomial hashes: their common extension is found by binary
search over hash equality, in logarithmic time, and a merge sort on that comparison orders them
(``sort_suffixes``), verifying bytes where hashes agree. One array of all suffixes of a cluster's
texts would need many times their size, so the corpus is first cut down, exactly:

1. Of the ``min_len - ANCHOR + 1`` places in a window of ``min_len`` bytes the one with the least
   hash is its *anchor*. Equal windows have equal anchors at equal offsets. Consecutive windows of
   one anchor are a *run*. Only runs that share their anchor with another run can hold repeats.
2. Runs of equal content are repeats as a whole.
3. Of what remains (edges of repeated passages) blocks of ``BLOCK`` windows are compared by their
   common core and as a whole.
4. Blocks that share the core alone are decided by the suffix sort, window by window: within each
   batch first, which sends one suffix for each class, then over ranges of the suffixes' bytes.

The exact reductions are hash aggregates with map-side combination and joins whose skew is split;
two runs or blocks count as equal if 128 bits of their hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BLOCK = 16
#: Bytes of one text that are hashed together; longer texts go in overlapping pieces.
PIECE = 1 << 20
#: Buckets of the filter that keeps texts without candidates out of the shuffle: a proven bound.
BUCKETS = 1 << 18
#: Suffixes of a range that one task sorts, on average.
SORTED = 20_000
#: First bytes by which suffixes are dealt out; a sample of them reaches the driver.
RANGE_BYTES = 48


def anchor_length(min_len: int) -> int:
    return max(1, min_len * 2 // 5)


class Hashes:
    """Prefix polynomial hashes (mod 2**64, mixed) of a byte array, with constant-time substrings."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes._powers) <= n:
            size = max(1 << 14, 1 << int(n).bit_length())
            for name, base in (("_powers", BASE), ("_inverses", INVERSE)):
                x = np.full(size, base)
                x[0] = 1
                setattr(Hashes, name, np.multiply.accumulate(x))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hashes._powers[:n], out=self.sums[1:])

    def of(self, begin, end) -> np.ndarray:
        """Hash of data[begin:end], elementwise; equal strings have equal hashes wherever they stand."""
        h = (self.sums[end] - self.sums[begin]) * Hashes._inverses[begin]
        h = (h ^ (h >> np.uint64(33))) * MIX1
        return h ^ (h >> np.uint64(29))

    def windows(self, k: int) -> np.ndarray:
        h = (self.sums[k:] - self.sums[:-k]) * Hashes._inverses[: len(self.sums) - k]
        h = (h ^ (h >> np.uint64(33))) * MIX1
        return h ^ (h >> np.uint64(29))


def second(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * MIX2
    return h ^ (h >> np.uint64(32))


def common(hashes: Hashes, a: np.ndarray, b: np.ndarray, limit: int, n: int) -> np.ndarray:
    """Length of the common extension of each pair of suffixes, up to ``limit``: binary search."""
    low, high = np.zeros(len(a), np.int64), np.minimum(limit, n - np.maximum(a, b))
    # most pairs that get here agree as far as they may
    same = hashes.of(a, a + high) == hashes.of(b, b + high)
    low[same] = high[same]
    open_ = np.flatnonzero(low < high)
    while open_.size:
        x, y, mid = a[open_], b[open_], (low[open_] + high[open_] + 1) // 2
        same = hashes.of(x, x + mid) == hashes.of(y, y + mid)
        low[open_[same]], high[open_[~same]] = mid[same], mid[~same] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def sort_suffixes(data: np.ndarray, at: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort of the suffixes that begin ``at``, by their first ``limit`` bytes.

    Returns the order and each suffix's common extension with the one before. All merges of a level
    run together: each step takes from every pair of sorted lists the smaller head, found through
    the common extension. Where a whole ``limit`` agrees by hash, bytes are compared too.
    """
    n, hashes, head = len(data), Hashes(data), min(8, limit)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    first = np.zeros(n, np.uint64)  # a suffix's first bytes as a number
    for k in range(head):
        first = (first << np.uint64(8)) | padded[k : k + n]

    def less_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = first[a], first[b]
        out = x < y
        open_ = np.flatnonzero(x == y)
        a, b = a[open_], b[open_]
        ext = common(hashes, a, b, limit, n)
        done = (ext == limit) | (np.maximum(a, b) + ext >= n)
        pa_, pb = np.minimum(a + ext, n - 1), np.minimum(b + ext, n - 1)
        out[open_] = np.where(done, np.where(ext == limit, True, a >= b), data[pa_] <= data[pb])
        return out

    order, width = np.asarray(at, np.int64).copy(), 1
    while width < len(order):
        out = np.empty_like(order)
        begins = np.arange(0, len(order), 2 * width)
        middle, end = np.minimum(begins + width, len(order)), np.minimum(begins + 2 * width, len(order))
        # rank of each element in the other list by binary search: a parallel merge
        left = np.arange(len(order)) // width % 2 == 0
        own = np.arange(len(order)) // (2 * width)
        low = np.where(left, middle[own], begins[own])
        high = np.where(left, end[own], middle[own])
        base = low.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            x, y = order[open_], order[mid]
            # a left element goes before equal right ones, a right element after equal left ones
            before = np.where(left[open_], ~less_equal(x, y), less_equal(y, x))
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        place = np.where(left, np.arange(len(order)) + (low - base), begins[own] + (np.arange(len(order)) - middle[own]) + (low - base))
        out[place] = order
        order, width = out, 2 * width
    ext = np.zeros(len(order), np.int64)
    if len(order) > 1:
        ext[1:] = common(hashes, order[:-1], order[1:], limit, n)
        full = np.flatnonzero(ext == limit)
        for k in range(0, len(full), 20_000):  # collision check
            rows = full[k : k + 20_000]
            step = np.arange(limit)
            equal = np.concatenate([(data[order[r - 1][:, None] + step] == data[order[r][:, None] + step]).all(axis=1) for r in np.array_split(rows, len(rows) // 500 + 1)])
            ext[rows[~equal]] = 0
    return order, ext


def runs_of(data: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first and last start, anchor place of each run in one text."""
    k = anchor_length(min_len)
    w, parts = min_len - k + 1, []
    for at in range(0, max(1, len(data) - min_len + 1), PIECE):
        piece = data[at : at + PIECE + min_len - 1]
        if len(piece) < min_len:
            break
        hashes = Hashes(piece)
        h = hashes.windows(k)
        key = (h & np.uint64(0xFFFFFFFFFFC00000)) | np.arange(len(h), dtype=np.uint64)  # PIECE + min_len < 2**22
        span = 1
        while span * 2 <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if w > span:
            key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
        pos = (key & np.uint64(0x3FFFFF)).astype(np.int64)
        u = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
        v = np.r_[u[1:], len(pos)] - 1
        p = pos[u]
        content = hashes.of(u, v + min_len) + (p - u).astype(np.uint64) * MIX2 + (v - u).astype(np.uint64) * BASE
        parts.append((h[p], second(content, 1), u + at, v + at, p + at))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))


def united(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of the union."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]]
    return begin[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def _keys(docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    """k1, k2 name a text: its id (null: the least long) and a digest, as ids may repeat."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(raw).alias("k2"), raw.alias("t"), *more)


def _bucket():
    return F.pmod(F.xxhash64("k1", "k2"), F.lit(BUCKETS)).alias("bucket")


def repeated_intervals(keyed: DataFrame, min_len: int = 400) -> DataFrame:
    """``k1, k2, lo, hi``: byte ranges, possibly overlapping, whose union is all that repeats."""

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k1, k2, t in zip(b[0].to_pylist(), b[1].to_pylist(), b[2]):
                h, c, u, v, p = runs_of(np.frombuffer(t.as_buffer(), np.uint8), min_len)
                if len(h):
                    out.append((h.view(np.int64), c.view(np.int64), np.full(len(h), k1), np.full(len(h), k2), u, v, p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h", "c", "k1", "k2", "u", "v", "p"])

    long_ = keyed.where(F.octet_length("t") >= min_len)
    runs = written(long_.mapInArrow(find_runs, "h long, c long, k1 long, k2 long, u long, v long, p long"), "runs")
    # classes of equal content, and the number of classes of each anchor
    classes = written(runs.groupBy("h", "c").agg(F.count("*").alias("n")), "classes")
    anchors = classes.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    status = written(classes.join(anchors, "h").select("h", "c", "n", (F.col("kinds") > 1).alias("mixed")), "status")
    found = written(runs.join(status, ["h", "c"]).select("c", "k1", "k2", "u", "v", "p", "n", "mixed"), "found")
    whole = found.where("n > 1").select("k1", "k2", F.col("u").alias("lo"), (F.col("v") + min_len).alias("hi"))
    # one run of each class of an anchor that has several: their windows are compared
    edge = found.where("mixed")
    single = edge.where("n = 1").drop("c", "mixed")
    several = edge.where("n > 1").groupBy("c").agg(F.min(F.struct("k1", "k2", "u", "v", "p", "n")).alias("r")).select("r.*")
    edges = written(single.unionByName(several), "edges")
    listed = edges.groupBy("k1", "k2").agg(F.collect_list(F.struct("u", "v", "p", "n")).alias("runs"))  # of one text
    near = F.broadcast(edges.select(_bucket()).distinct())
    texts = long_.withColumn("bucket", _bucket()).join(near, "bucket", "left_semi").drop("bucket").dropDuplicates(["k1", "k2"])

    def find_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, t, found_ in zip(b[0].to_pylist(), b[1].to_pylist(), b[2], b[3].to_pylist()):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                hashes = Hashes(data)
                u, v, p, n = (np.array([r[x] for r in found_], np.int64) for x in ("u", "v", "p", "n"))
                # block j of a run: windows that begin BLOCK * j to BLOCK * j + BLOCK - 1 before its anchor
                first, last = (p - v) // BLOCK, (p - u) // BLOCK
                many = last - first + 1
                run = np.repeat(np.arange(len(u)), many)
                j = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + first[run]
                top, bottom = p[run] - BLOCK * j, p[run] - BLOCK * j - BLOCK + 1
                lo, hi = np.maximum(bottom, u[run]), np.minimum(top, v[run])
                core = second(hashes.of(top, bottom + min_len), 2) + j.astype(np.uint64) * BASE
                block = second(hashes.of(lo, hi + min_len) + (lo - bottom).astype(np.uint64) * MIX2 + (hi - lo).astype(np.uint64) * BASE, 3)
                m = len(run)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(block.view(np.int64)), pa.array(np.full(m, k1)), pa.array(np.full(m, k2)), pa.array(lo), pa.array(hi - lo), pa.array(top), pa.array(n[run] > 1)], ["core", "block", "k1", "k2", "lo", "more", "top", "known"])

    joined = texts.join(listed, ["k1", "k2"]).select("k1", "k2", "t", "runs")
    blocks = written(joined.mapInArrow(find_blocks, "core long, block long, k1 long, k2 long, lo long, more long, top long, known boolean"), "blocks")
    kinds = written(blocks.groupBy("core", "block").agg(F.count("*").alias("n")), "kinds")
    cores = kinds.groupBy("core").agg(F.sum("n").alias("total"), F.count("*").alias("classes")).where("total > 1")
    shared = written(kinds.join(cores, "core").select("core", "block", "n", "classes"), "cores")
    alike = written(blocks.join(shared, ["core", "block"]).select("k1", "k2", "lo", "more", "top", "known", "n", "classes", "core", "block"), "alike")
    same = alike.where("n > 1 and not known").select("k1", "k2", "lo", (F.col("lo") + F.col("more") + min_len).alias("hi"))
    # blocks that share the core with others of another content: one of each content by windows
    mixed = alike.where("classes > 1")
    lone = mixed.where("n = 1").select("core", "k1", "k2", "lo", "more", "top", "known")
    group = mixed.where("n > 1").groupBy("core", "block").agg(F.min(F.struct("k1", "k2", "lo", "more", "top")).alias("r")).select("core", "r.*", F.lit(True).alias("known"))
    parts = written(lone.unionByName(group), "parts")
    listed = parts.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "lo", "more", "top", "known")).alias("parts"))  # of one text
    near = F.broadcast(parts.select(_bucket()).distinct())
    texts = long_.withColumn("bucket", _bucket()).join(near, "bucket", "left_semi").drop("bucket").dropDuplicates(["k1", "k2"])
    cut = F.transform("parts", lambda p: F.struct(p["core"].alias("core"), p["lo"].alias("lo"), p["more"].alias("more"), p["top"].alias("top"), p["known"].alias("known"), F.substring("t", (p["lo"] + 1).cast("int"), (p["more"] + min_len).cast("int")).alias("bytes")))
    pieces = texts.join(listed, ["k1", "k2"]).select("k1", "k2", F.explode(cut).alias("p")).select("k1", "k2", "p.*")
    pieces = written(pieces, "pieces")
    one = sorted_repeats(pieces, min_len).select("k1", "k2", "lo", (F.col("lo") + min_len).alias("hi"))
    return whole.unionByName(same).unionByName(one)


def sorted_repeats(pieces: DataFrame, min_len: int) -> DataFrame:
    """``k1, k2, lo``: windows of ``pieces`` whose bytes stand elsewhere too, but for ``known`` ones.

    A piece has ``more + 1`` windows from ``lo`` on, and ``core`` and ``top`` name what it shares with
    others. Each batch sorts the suffixes that may be equal and sends one head for each class. A head
    whose hash no other has is unique. The others are dealt out by ranges of their first
    bytes and sorted again; where neighbours agree over the whole length their bytes are compared,
    so no hash decides that two windows are equal.
    """

    def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            core, k1, k2, lo, many, top, known = (b[c].to_numpy(zero_copy_only=False) for c in ("core", "k1", "k2", "lo", "more", "top", "known"))
            data, many = np.frombuffer(b"".join(b["bytes"].to_pylist()), np.uint8), many + 1
            size = many + min_len - 1
            row = np.repeat(np.arange(len(core)), many)
            step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = (np.cumsum(size) - size)[row] + step
            start = lo[row] + step
            w = Hashes(data).of(at, at + min_len)
            # windows can be equal only with the same core at the same distance
            key = second(core[row].view(np.uint64) + (top[row] - start).astype(np.uint64) * BASE, 4)
            _, group, held = np.unique(key, return_inverse=True, return_counts=True)
            met = np.flatnonzero(held[group] > 1)
            count, head = np.ones(len(row), np.int64), np.arange(len(row))
            if len(met):
                order, ext = sort_suffixes(data, at[met], min_len)
                # order holds places of data; back to rows through the places' own order
                back = met[np.argsort(at[met])][np.searchsorted(np.sort(at[met]), order)]
                first = np.flatnonzero(ext < min_len)
                many_ = np.diff(np.r_[first, len(order)])
                count[back] = 0
                count[back[first]] = many_
                head[back] = np.repeat(back[first], many_)
            keep = np.flatnonzero(~known[row] | (count > 0))
            of = head[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w.view(np.int64)[keep], k1[row][keep], k2[row][keep], lo[row][keep], step[keep], count[keep], known[row][keep], k1[row][of], k2[row][of], start[of])], ["w", "k1", "k2", "piece", "step", "n", "known", "h1", "h2", "hlo"])

    slim = pieces.select("core", "k1", "k2", "lo", "more", "top", "known", "bytes")
    windows = written(slim.mapInArrow(find_windows, "w long, k1 long, k2 long, piece long, step long, n long, known boolean, h1 long, h2 long, hlo long"), "windows")
    twice = written(windows.groupBy("w").agg(F.sum("n").alias("total")).where("total > 1").select("w"), "twice")
    open_ = written(windows.join(twice, "w"), "open-windows")
    heads = open_.where("n > 0").groupBy("k1", "k2", "piece").agg(F.collect_list(F.struct("step", "n")).alias("at"))  # of one piece
    suffix = F.substring("bytes", (F.col("w.step") + 1).cast("int"), F.lit(min_len)).alias("suffix")
    loaded = heads.join(pieces.withColumnRenamed("lo", "piece").select("k1", "k2", "piece", "bytes"), ["k1", "k2", "piece"]).select("k1", "k2", "piece", "bytes", F.explode("at").alias("w"))
    suffixes = written(loaded.select("k1", "k2", (F.col("piece") + F.col("w.step")).alias("lo"), "w.n", suffix), "suffixes")
    ranges = -(-suffixes.count() // SORTED) or 1

    def sort_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "lo"]
        # one head of each class so far, what the class holds, and whether its heads have been sent
        kept, total, told, waiting = None, np.zeros(0, np.int64), np.zeros(0, bool), []

        def sort_waiting() -> pa.RecordBatch:
            nonlocal kept, total, told
            t = pa.Table.from_batches(waiting if kept is None else [*kept.to_batches(), *waiting])
            waiting.clear()
            n, sent = np.r_[total, t["n"].to_numpy()[len(total) :]], np.r_[told, np.zeros(t.num_rows - len(told), bool)]
            order, ext = sort_suffixes(np.frombuffer(b"".join(t["suffix"].to_pylist()), np.uint8), np.arange(t.num_rows) * min_len, min_len)
            order = order // min_len
            first = np.flatnonzero(ext < min_len)
            total = np.add.reduceat(n[order], first)
            told = total > 1
            new = order[np.repeat(told, np.diff(np.r_[first, len(order)])) & ~sent[order]]
            kept = t.take(pa.array(order[first])).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[new]) for c in names], names)

        for b in batches:
            if b.num_rows:
                waiting.append(b)
            if sum(x.num_rows for x in waiting) >= SORTED:
                yield sort_waiting()
        if waiting:
            yield sort_waiting()

    repeated = suffixes.select("k1", "k2", "lo", "n", "suffix").repartitionByRange(ranges, F.substring("suffix", 1, RANGE_BYTES)).mapInArrow(sort_range, "k1 long, k2 long, lo long")
    repeated = written(repeated.toDF("h1", "h2", "hlo"), "repeated")
    mine = open_.where("not known").select("k1", "k2", (F.col("piece") + F.col("step")).alias("lo"), "h1", "h2", "hlo")
    return mine.join(repeated, ["h1", "h2", "hlo"]).select("k1", "k2", "lo")


def repeated_spans(keyed: DataFrame, min_len: int) -> DataFrame:
    """``k1, k2, cut``: each text's maximal ranges of bytes that repeats of ``min_len`` cover."""
    # a set, so that many equal rows of one text count once on either side of the shuffle
    each = repeated_intervals(keyed, min_len).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("cut"))  # of one text

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, flat = b["cut"].offsets.to_numpy(), b["cut"].values
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            parts = [united(lo[i:j], hi[i:j]) for i, j in zip(at, at[1:])]
            out = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["lo", "hi"])
            ends = np.cumsum([0, *(len(x) for x, _ in parts)])
            yield pa.RecordBatch.from_arrays([b["k1"], b["k2"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out)], ["k1", "k2", "cut"])

    return written(each.mapInArrow(unite, "k1 long, k2 long, cut array<struct<lo:long,hi:long>>"), "spans")


def _inside(keyed: DataFrame, outer: DataFrame, min_len: int) -> DataFrame:
    """The spans of repeats of ``min_len`` bytes, given those of a lesser length, ``outer``.

    A longer repeat lies within the union of the shorter ones, so only its ranges are judged, and of
    equal ranges one stands for all: what stands twice as a whole goes, and is still compared.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for k1, k2, t, ranges in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist(), b[3].to_pylist()):
                for r in ranges:
                    i, j = r["lo"], r["hi"]
                    if j - i >= min_len:
                        d = xxhash.xxh3_128_digest(t[i:j])
                        rows.append((k1, k2, i, j - i, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), t[i:j]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["k1", "k2", "off", "size", "d1", "d2", "t"])

    some = outer.where(F.exists("cut", lambda c: c["hi"] - c["lo"] >= min_len))
    texts = keyed.where(F.octet_length("t") >= min_len).join(some, ["k1", "k2"]).select("k1", "k2", "t", "cut")
    ranges = written(texts.mapInArrow(take, "k1 long, k2 long, off long, size long, d1 long, d2 long, t binary"), "ranges")
    many = written(ranges.groupBy("d1", "d2").agg(F.count("*").alias("n")), "range-classes")
    kinds = written(ranges.select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "t").dropDuplicates(["k1", "k2"]), "range-kinds")
    parts = repeated_spans(kinds, min_len).select(F.col("k1").alias("d1"), F.col("k2").alias("d2"), "cut")
    placed = ranges.select("k1", "k2", "off", "size", "d1", "d2").join(many, ["d1", "d2"]).join(parts, ["d1", "d2"], "left")
    moved = F.transform("cut", lambda c: F.struct((F.col("off") + c["lo"]).alias("lo"), (F.col("off") + c["hi"]).alias("hi")))
    cut = F.when(F.col("n") > 1, F.array(F.struct(F.col("off").alias("lo"), (F.col("off") + F.col("size")).alias("hi")))).otherwise(F.coalesce(moved, F.array()))
    # ranges of one text don't touch; equal rows have equal ones
    return written(placed.withColumn("cut", cut).groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_set("cut"))).alias("cut")), "inner-spans")


def _characters(raw: bytes, lo: list[int], hi: list[int]) -> bytes:
    """``raw`` without the ranges; a character that a range covers in part stays whole."""
    if not lo:
        return raw
    inside = lambda p: p < len(raw) and raw[p] & 0xC0 == 0x80
    for k in range(len(lo)):
        while inside(lo[k]):
            lo[k] += 1
        while inside(hi[k]):
            hi[k] -= 1
    return b"".join(raw[i:j] for i, j in zip([0, *hi], [*lo, len(raw)]))


def dedup_suffixes(docs: DataFrame, *, min_len: int = 400, passage_len: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove each byte covered by a ``min_len``-byte string that also starts anywhere else.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary), a row for each input row. All
    copies go, the first as well; strings are judged on the input. A null text counts as empty; a
    repeated row repeats its own strings; a null id is an id of its own and comes back as null.
    Texts shorter than ``min_len`` stay as they are. Other columns aren't read.

    With ``passage_len`` (less than ``min_len``) the same search also gives ``passage_bytes,
    passage_spans`` and ``text``: what repeats of that length cover, and the text without them, cut
    between characters. The longer repeats are then looked for within the shorter ones alone.
    """
    small_batches(docs.sparkSession)
    keyed = _keys(docs, doc_id, text)
    if passage_len is None:
        outer = repeated_spans(keyed, min_len)
        spans = outer
    else:
        outer = repeated_spans(keyed, passage_len)
        spans = outer.withColumnRenamed("cut", "passages").join(_inside(keyed, outer, min_len), ["k1", "k2"], "left").select("k1", "k2", "cut", "passages")
    near = F.broadcast(outer.select(_bucket()).distinct())
    tagged = keyed.withColumn("bucket", _bucket())
    ident, zero = F.when(F.col("k1") != -(2**63), F.col("k1")).alias("doc_id"), F.lit(0).cast("long")
    columns = ["n_bytes", "n_removed", "n_spans", "kept"] + ["passage_bytes", "passage_spans", "text"] * (passage_len is not None)
    as_text = F.col("t").cast("string").alias("text")
    clean = tagged.join(near, "bucket", "left_anti").select(ident, F.octet_length("t").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("t").alias("kept"), zero.alias("passage_bytes"), zero.alias("passage_spans"), as_text).select("doc_id", *columns)
    kinds = {"kept": "binary", "text": "string"}

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in columns}
            texts = b[1].to_pylist()
            for k in range(2, b.num_columns):
                for t, ranges in zip(texts, b[k].to_pylist()):
                    lo, hi = [r["lo"] for r in ranges or ()], [r["hi"] for r in ranges or ()]
                    out[columns[3 * k - 5]].append(sum(hi) - sum(lo))
                    out[columns[3 * k - 4]].append(len(lo))
                    out[columns[3 * k - 3]].append((t if not lo else b"".join(t[i:j] for i, j in zip([0, *hi], [*lo, len(t)]))) if k == 2 else _characters(t, lo, hi).decode())
            out["n_bytes"] = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b[0], *(pa.array(x, pa.binary() if c == "kept" else pa.string() if c == "text" else pa.int64()) for c, x in out.items())], ["k1", *columns])

    maybe = tagged.join(near, "bucket", "left_semi").drop("bucket").join(spans, ["k1", "k2"], "left").select("k1", "t", *spans.columns[2:])
    done = maybe.mapInArrow(remove, "k1 long, " + ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns)).select(ident, *columns)
    return clean.unionByName(done)


def without_repeats(docs: DataFrame, *, min_len: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of their texts; columns and rows as they were.

    Cuts fall between characters: one that is covered in part stays whole. ``n_chars``, where the
    table has it, follows the text. Null texts stay null.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(_keys(docs, doc_id, text), min_len)
    near = F.broadcast(spans.select(_bucket()).distinct())
    # the caller's row stands in a struct, so that no name can clash
    keyed = _keys(docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("i"), F.col(text).alias("s")), "i", "s", "row").drop("t").withColumn("bucket", _bucket())
    clean = keyed.join(near, "bucket", "left_anti").select("row.*")
    maybe = keyed.join(near, "bucket", "left_semi").join(spans, ["k1", "k2"], "left").select("row.*", "cut")
    at, plain = docs.columns.index(text), docs.schema
    n_chars = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[:-1])
            out = []
            for t, ranges in zip(columns[at].to_pylist(), b[b.num_columns - 1].to_pylist()):
                if t is not None and ranges:
                    t = _characters(t.encode(), [r["lo"] for r in ranges], [r["hi"] for r in ranges]).decode()
                out.append(t)
            columns[at] = pa.array(out, columns[at].type)
            if n_chars is not None:
                columns[n_chars] = pa.array([n if t is None else len(t) for n, t in zip(columns[n_chars].to_pylist(), out)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return clean.unionByName(maybe.mapInArrow(remove, plain))
