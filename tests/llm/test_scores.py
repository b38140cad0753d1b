import hashlib
import math
import random
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, table, words
from pyspark.sql import functions as F

from tessellate.llm import license_scan, media, packing, toxicity
from tessellate.llm.queries import QUERIES, vocabulary


# licenses


def brute_base(text):
    raw = "".join(c.lower() if c.isascii() else c for c in (text or ""))
    w = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) >= 128 else " " for c in raw).split(" ")
    w = [x for x in w if x]
    hits = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def license_rows():
    rng = random.Random(6)
    rows = awkward()
    for k, (_, text) in enumerate(license_scan.TEMPLATES):
        t = text.split()
        rows.append((500 + k, words(rng, 60) + "\n" + text.title() + ".\n" + words(rng, 30)))
        rows.append((600 + k, words(rng, 20) + " " + " ".join(t[: len(t) // 2] + ["extra"] + t[len(t) // 2 :])))
        rows.append((700 + k, " ".join(rng.sample(t, max(1, len(t) * 3 // 4))) + " " + words(rng, 50)))
        rows.append((800 + k, (" " + words(rng, 9) + " ").join(t)))
    rows += [(900, "CC BY cc-by; CC  BY\nAll Rights Reserved. all rights reserved GENERAL public LICENSE"), (901, "ccby cc b y"), (902, "é" + "cc by é all rights\x00reserved")]
    return rows


def test_license_scan_is_exact(spark):
    rows = license_rows()
    got = license_scan.license_scan(table(spark, rows)).collect()
    have = sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got), key=str)
    want = []
    for i, t in rows:
        base = brute_base(t)
        labels = license_scan.brute_blocks(t or "") | set(filter(None, base[4].split(",")))
        want.append((str(i), *base, ",".join(sorted(labels))))
    assert have == sorted(want, key=str)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert sum(bool(r.blocks) for r in got) > len(license_scan.TEMPLATES)


def test_every_block_of_a_template_is_found(spark):
    rng = random.Random(12)
    rows = [r for r in license_rows() if len(r[1] or "") < 5000]
    mit, bsd = license_scan.TEMPLATES[0][1], license_scan.TEMPLATES[7][1]
    rows.append((2000, " ".join([words(rng, 40), mit, words(rng, 50), mit, mit, words(rng, 3), bsd, words(rng, 90), bsd, words(rng, 30), mit])))
    got = license_scan.license_scan(table(spark, rows)).collect()
    have = sorted(((str(r.doc_id), sorted((b.label, b.word, b.end, b.containment) for b in r.blocks)) for r in got), key=str)
    assert have == sorted(((str(i), license_scan.brute_stretches(t or "")) for i, t in rows), key=str)
    assert sum(b.label == "bsd" for r in got if r.doc_id == 2000 for b in r.blocks) == 2
    assert sum(b.label == "mit" for r in got if r.doc_id == 2000 for b in r.blocks) > 2


def test_license_scan_counts_all_documents(spark):
    rows = [(1, "the mit the"), (2, "The license"), (3, None)]
    n = license_scan.token_frequency(table(spark, rows))
    assert (n["the"], n["mit"], n["license"], n.get("gnu")) == (2, 1, 1, None)
    assert license_scan.license_scan(table(spark, [])).collect() == []


def test_license_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in QUERIES["op10_license_scan"](spark, sf).collect()}
    assert got == {r.doc_id: brute_base(r.text) for r in docs}


# media


def brute_media(text):
    raw = (text or "").encode()
    payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_media_round_trip(spark, tmp_path):
    rows = awkward()
    got = media.media_table(table(spark, rows), folder=f"file://{tmp_path}/m").collect()
    assert sorted(((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)) == sorted((str(i), *brute_media(t)) for i, t in rows)
    stored = {}
    for path in (tmp_path / "m").iterdir():
        with tarfile.open(path) as tar:
            for member in tar:
                stored[member.name[:64]] = tar.extractfile(member).read()
    assert set(stored) == {r.payload_sha256 for r in got}
    for r in got:
        x = stored[r.payload_sha256]
        assert (len(x), hashlib.sha256(x).hexdigest()) == (r.media_bytes, r.media_sha256)
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.begin)
            assert f.read(r.length) == x
        assert hashlib.sha256(media.from_png(x)).hexdigest() == r.payload_sha256
        assert (r.width, r.height) == (64, r.payload_bytes // 64)
    assert len({(r.payload_sha256, r.media_sha256, r.feature, r.shard, r.begin) for r in got}) == len(stored)


def test_media_headers_and_damage(spark, tmp_path):
    index = media.store_media(table(spark, [(1, "abc"), (2, "x" * 1000)]), folder=f"file://{tmp_path}/m")
    assert {(r.width, r.height, r.bit_depth) for r in media.media_columns(index).collect()} == {(64, 1, 8), (64, 16, 8)}
    good = media.to_png(b"a" * 128)
    assert media.from_png(good) == b"a" * 128
    with pytest.raises(ValueError):
        media.from_png(good[:50] + bytes([good[50] ^ 1]) + good[51:])
    assert media.media_table(table(spark, []), folder=f"file://{tmp_path}/e").collect() == []


# toxicity


def test_chain_equals_brute_force():
    rng = np.random.default_rng(1)
    em, first = rng.normal(size=700), np.zeros(700, bool)
    first[[0, 5, 6, 300, 301, 640]] = True
    trans, start = np.exp(rng.normal(size=(2, 2))), np.exp(rng.normal(size=2))
    got = toxicity.marginals(em, first, trans, start)
    for b, e in zip(np.flatnonzero(first), [*np.flatnonzero(first)[1:], 700]):
        e_ = np.stack([np.ones(e - b), np.exp(em[b:e])], axis=1)
        fwd, bwd = np.zeros((e - b, 2)), np.ones((e - b, 2))
        fwd[0] = start * e_[0]
        for t in range(1, e - b):
            fwd[t] = (fwd[t - 1] @ trans) * e_[t]
            fwd[t] /= fwd[t].sum()
        for t in range(e - b - 2, -1, -1):
            bwd[t] = trans @ (e_[t + 1] * bwd[t + 1])
            bwd[t] /= bwd[t].sum()
        p = fwd * bwd
        assert np.allclose(got[b:e], p[:, 1] / p.sum(axis=1))


def toxic_rows(seed=2):
    rng = random.Random(seed)
    bad = ["awful", "vile", "snark"] + ["gruml" + e for e in ("a", "eb", "osh", "ity", "end")]
    rows, labels = [], []
    for i in range(400):
        w, y = words(rng, rng.randint(15, 120)).split(), i % 4 == 0
        if y:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad).title() + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return rows, labels, bad


def test_toxic_documents_and_spans(spark):
    rows, labels, bad = toxic_rows()
    extra = [(1000, None), (1001, ""), (None, "Vile grumlity"), (1002, "ÉÉ vile 漢字"), (1003, "clean " * 9000), (0, "a vile twin of an id")]
    truth = dict(labels)
    docs = table(spark, rows + extra)
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == (i in held) for i, _ in rows)
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    assert all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in got if r.doc_id in held & set(truth) and r.doc_id)
    text = dict(rows)
    for r in got:
        if r.doc_id in text and r.doc_id in held and truth[r.doc_id] and r.doc_id:
            said = " ".join(text[r.doc_id][s.begin : s.end] for s in r.spans).lower()
            assert any(b in said for b in bad)
    one = next(r for r in got if r.doc_id == 1002)
    assert [(s.begin, s.end) for s in one.spans] == [(3, 7)] and all(0 <= r.score <= 1 for r in got)
    assert {r.score < 0.5 for r in got if r.doc_id in (1000, 1001, 1003)} == {True}
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.5}


def test_labels_are_never_inputs(spark):
    rows, labels, _ = toxic_rows()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = [(i, 1 - y if i in held else y) for i, y in labels]
    docs = table(spark, rows)
    a, b = (toxicity.learn(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.weights == b.weights and a.logit == b.logit


def test_toxicity_without_labels(spark):
    docs = table(spark, [(1, "x y")])
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score < 0.5 for r in toxicity.toxicity(docs, model).collect()] == [True]
    assert toxicity.toxicity(table(spark, []), model).collect() == []


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    held = [(r.toxic, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(bool(y) == (r.predicted == 1) for y, r in held)
    assert len(held) > 50 and right / len(held) >= 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())


# packing


def test_packing_places_every_token_once(spark):
    rng = random.Random(7)
    counts = [(i, rng.choice([0, 1, 7, 100, 511, 512, 513, 3000, 8192, 20_000])) for i in range(500)] + [(None, 40), (3, 40), (3, 40), (9, None)]
    df = spark.createDataFrame(counts, "doc_id long, n_tokens long")
    got = packing.packed(df, shard_items=120).collect()
    whole = Counter()
    bins = {}
    for r in got:
        whole[r.doc_id] += r.n_tokens
        bins.setdefault((r.bin, r.bin_size), []).append((r.offset, r.offset + r.n_tokens))
        assert r.bin_size in packing.SIZES and r.begin == r.piece * 8192
    want = Counter()
    for i, n in counts:
        if n:
            want[i] += n
    assert whole == want
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        fill = spans[-1][1]
        assert size == min(s for s in packing.SIZES if s >= fill)
    assert packing.packed(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


def linear_best_fit(lengths, sizes, overhead):
    """Every open bin is looked at for each item, and every length is filled item by item for each opening."""
    bins, left = [], sorted(lengths, reverse=True)
    while left:
        n = left.pop(0)
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0] - b[1], -b[2]))  # of equal ones the last touched
        else:
            costs = []
            for size in (s for s in sizes if s >= n):
                fill = n
                for x in left:
                    fill += x if fill + x <= size else 0
                costs.append(((min(s for s in sizes if s >= fill) + overhead) / fill, size))
            bins.append(b := [min(costs)[1], 0, 0])
        b[1:] = b[1] + n, -len(left)
    return sorted((size, fill) for size, fill, _ in bins)


@pytest.mark.parametrize("overhead", [0, 16, 300])
def test_best_fit_equals_a_linear_scan(overhead):
    rng = random.Random(overhead)
    for _ in range(60):
        sizes = tuple(sorted(rng.sample(range(20, 400), rng.randint(1, 5))))
        lengths = sorted((rng.randint(1, sizes[-1]) for _ in range(rng.randint(0, 80))), reverse=True)
        where, fill, capacity = packing.best_fit(lengths, sizes, overhead)
        assert sorted(zip(capacity, fill)) == linear_best_fit(lengths, sizes, overhead)
        assert np.bincount(where, lengths, minlength=len(fill)).tolist() == fill
        bins, offset, final = packing.pack(np.array(lengths, np.int64), sizes, overhead)
        assert final.tolist() == [min(s for s in sizes if s >= f) for f in fill] and bins.tolist() == where


def test_best_fit_takes_the_tightest_bin():
    where, fill, capacity = packing.best_fit([6, 5, 4, 3, 2], (8, 16), 0)
    assert where == [0, 1, 2, 1, 0] and fill == [8, 8, 4] and capacity == [8, 8, 8]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 4000, 3000)
    bins, _, final = packing.pack(lengths, packing.SIZES)
    assert final.sum() < 1.05 * lengths.sum()
    assert math.isclose(np.bincount(bins, lengths, minlength=len(final)).sum(), lengths.sum())


def test_packing_agrees_however_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 7)
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, i]), rng.choice([5, 600, 9000])) for i in range(300)]
    frames = [spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(3), spark.createDataFrame(rows[::-1], "doc_id long, n_tokens long").coalesce(1)]
    one, other = (Counter(map(tuple, packing.packed(f, shard_items=60).collect())) for f in frames)
    assert one == other and sum(r[3] for r in one.elements()) == sum(n for _, n in rows)


def test_packing_query(spark, sf):
    got = QUERIES["op2_packing"](spark, sf).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    want = {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, sf).collect() if r.n_tokens}
    assert {r.doc_id: r.n for r in got} == want
    assert vocabulary("byte_bpe_50k.json")
