import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import awkward, table, words

from tessellate.llm import simhash, suffix_dedup
from tessellate.llm.queries import QUERIES


def brute_suffix(rows, k):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + k] for d in data for i in range(len(d) - k + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for p in range(len(d) - k + 1):
            if seen[d[p : p + k]] > 1:
                gone[p : p + k] = b"\x01" * k
        spans = sum(1 for p in range(len(d)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def suffix(df, k):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup_suffixes(df, min_len=k).collect()), key=str)


@pytest.mark.parametrize("k", [400, 60])
def test_suffix_dedup_is_exact(spark, k):
    rows = awkward()
    assert suffix(table(spark, rows), k) == brute_suffix(rows, k)


def test_suffix_dedup_of_two_lengths(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED", 30)  # many ranges, each sorted in several turns
    rng = random.Random(9)
    base = words(rng, 60)
    rows = awkward() + [(200 + i, words(rng, 3) + base[i : i + 150 + i % 30] + words(rng, 3)) for i in range(30)]
    got = suffix_dedup.dedup_suffixes(table(spark, rows), min_len=150, passage_len=60).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute_suffix(rows, 150)
    short = brute_suffix(rows, 60)
    assert sorted(((r.doc_id, r.n_bytes, r.passage_bytes, r.passage_spans) for r in got), key=str) == sorted((r[:4] for r in short), key=str)
    plain = {i for i, t in rows if i and (t or "").isascii()}
    assert sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in got if r.doc_id in plain), key=str) == sorted(((r[0], r[4]) for r in short if r[0] in plain), key=str)


def test_suffix_dedup_periods_and_edges(spark):
    rng = random.Random(3)
    base = words(rng, 40)
    rows = [(i, words(rng, 3) + base[i : i + 100 + i % 7] + words(rng, 3)) for i in range(40)] + [(100, "ab" * 300), (101, "b" + "ab" * 90), (102, "ab" * 31 + "c" + "ab" * 31)]
    assert suffix(table(spark, rows), 50) == brute_suffix(rows, 50)


def test_suffix_dedup_empty_table(spark):
    assert suffix(table(spark, []), 400) == []


def test_suffix_query_on_a_whole_table(spark, sf):
    found = QUERIES["op1_suffix_dedup"](spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r)[:5] for r in found) == sorted(brute_suffix(rows, 400))
    assert sorted((r.doc_id, r.n_bytes, r.passage_bytes, r.passage_spans) for r in found) == sorted(r[:4] for r in brute_suffix(rows, 250))


def test_suffix_sort_orders_and_measures():
    rng = random.Random(5)
    data = np.frombuffer("".join(rng.choices("ab", k=3000)).encode(), np.uint8)
    at = np.array(rng.sample(range(2900), 700))
    order, ext = suffix_dedup.sort_suffixes(data, at, 64)
    text = data.tobytes()
    cut = [text[p : p + 64] for p in order]
    assert cut == sorted(text[p : p + 64] for p in at) and sorted(order) == sorted(at)
    for a, b, e in zip(cut, cut[1:], ext[1:]):
        assert a[:e] == b[:e] and (e == 64 or a[e] != b[e])


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rng = random.Random(8)
    a, b = words(rng, 400), words(rng, 400)
    runs = suffix_dedup.runs_of(np.frombuffer((a + b + a).encode(), np.uint8), 80)
    covered = np.zeros(len(a + b + a), bool)
    for u, v in zip(runs[2], runs[3]):
        covered[u : v + 1] = True
    assert covered[: len(covered) - 79].all()


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius):
    fps = [(i, brute_fp(t)) for i, t in rows]
    values = sorted({f for _, f in fps})
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for i, f in fps:
        if i is not None:
            low[find(f)].append(i)
    return sorted(((i, f"{f:016x}", min(low[find(f)], default=None)) for i, f in fps), key=str)


def near(seed):
    rng = random.Random(seed)
    rows = awkward(seed)
    base = words(rng, 400).split()
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((1000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_simhash_components(spark, monkeypatch, small):
    if small:  # many shards and levels
        monkeypatch.setattr(simhash, "SHARD", 40)
        monkeypatch.setattr(simhash, "LEAF", 8)
    rows = near(2)
    got = sorted((tuple(r) for r in simhash.simhash_components(table(spark, rows)).collect()), key=str)
    assert got == brute_components(rows, 2)


def test_simhash_empty(spark):
    assert simhash.simhash_components(table(spark, [])).collect() == []


def test_simhash_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r)[:3] for r in QUERIES["op5_simhash"](spark, sf).collect()), key=str) == brute_components(rows, 2)


def test_vantage_tree_finds_every_pair():
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fp = np.unique(np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 63, 60, dtype=np.uint64)) for _ in range(30)] + [rng.integers(0, 2**63, 3000, dtype=np.uint64)]))
    links = list(simhash.near_links(fp, 2))
    a, b = (np.searchsorted(fp, np.concatenate(x)) for x in zip(*links))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    assert np.array_equal(simhash.local_roots(len(fp), a, b), simhash.local_roots(len(fp), i, j))
