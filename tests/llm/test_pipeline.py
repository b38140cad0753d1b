import random

from helpers import awkward, table, words

import corpus_pipeline
from tessellate.llm import near_dedup, suffix_dedup


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_rows(seed=11):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(3, 300))) for i in range(60)]
    copies = {}
    for k, i in enumerate(range(10, 30)):
        w = rows[i][1].split()
        edits = max(1, len(w) // 90)
        for _ in range(edits):
            w[rng.randrange(len(w))] = words(rng, 1)
        copies[1000 + k] = i
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, rows[5][1]), (2001, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]), (3000, None), (3001, ""), (3002, " \n")]
    return rows, copies


def test_one_of_each_group_of_copies_stays(spark):
    rows, copies = near_rows()
    docs = table(spark, rows)
    out = near_dedup.without_near_copies(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept))
    text = dict((i, t) for i, t in rows if i is not None)
    for copy, i in copies.items():
        a, b = shingles(text[copy]), shingles(text[i])
        if len(a & b) / len(a | b) >= 0.8:
            assert i in kept and copy not in kept
    assert 5 in kept and 2000 not in kept and 2001 not in kept and 6 in kept and None not in kept
    assert all(i in kept for i in [*range(10), *range(30, 60)])
    assert sum(i in kept for i in (3000, 3001, 3002)) >= 1
    assert near_dedup.without_near_copies(table(spark, [])).collect() == []


def test_sketches_measure_similarity():
    rng = random.Random(1)
    a = words(rng, 400).encode()
    b = a + b" " + words(rng, 60).encode()
    x, y = (near_dedup.np.unique(near_dedup.shingle_hashes(t, 5))[: near_dedup.SKETCH] for t in (a, b))
    s, t = shingles(a.decode()), shingles(b.decode())
    assert abs(near_dedup.jaccard(x, y) - len(s & t) / len(s | t)) < 1e-9
    assert near_dedup.bands(near_dedup.shingle_hashes(b"", 5)) == []


def test_repeats_leave_texts(spark):
    rows = awkward()
    docs = table(spark, rows)
    out = suffix_dedup.without_repeats(docs, min_len=250)
    assert out.columns == docs.columns and out.count() == len(rows)
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for p in range(len(d) - 249):
            seen[d[p : p + 250]] = seen.get(d[p : p + 250], 0) + 1
    want = []
    for (i, t), d in zip(rows, data):
        gone = bytearray(len(d))
        for p in range(len(d) - 249):
            if seen[d[p : p + 250]] > 1:
                gone[p : p + 250] = b"\x01" * 250
        want.append((str(i), t if t is None else t if not any(gone) else None, len(d) - sum(gone)))
    got = out.collect()
    sizes = sorted((str(r.doc_id), len((r.text or "").encode())) for r in got)
    # characters that are covered in part stay whole: at most three bytes more at either end
    for (i, n), (j, m) in zip(sizes, sorted((i, n) for i, _, n in want)):
        assert i == j and 0 <= n - m <= 12
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)
    assert sum(r.text is None for r in got) == sum(t is None for _, t in rows)


def test_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-copies", "repeats", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf).cache()
        assert after.columns == docs.columns
        if name in ("toxicity", "near-copies"):
            assert 0 < after.count() <= kept.count()
        if name == "repeats":
            assert after.count() == kept.count()
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.count() >= kept.where("length(text) > 0").count()


def test_pipeline_takes_awkward_tables(spark, tmp_path):
    docs = table(spark, awkward())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20
    table(spark, []).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def template_texts(seed, edits, pairs, singles, apart, n_words=510):
    """Copies of one text with ``edits`` words of their own, and pairs of them of which ``apart`` edits differ."""
    rng = random.Random(seed)
    base = words(rng, n_words).split()

    def put(text, places):
        for p in places:
            text[p] = "".join(rng.choices("klmnop", k=9))
        return text

    out = []
    for k in range(pairs):
        places = rng.sample(range(5, n_words - 5, 5), edits + apart)
        common = put(list(base), places[: edits - apart])
        out += [(2 * k, " ".join(put(list(common), places[edits - apart : edits]))), (2 * k + 1, " ".join(put(list(common), places[edits:])))]
    return out + [(10_000 + k, " ".join(put(list(base), rng.sample(range(5, n_words - 5, 5), edits)))) for k in range(singles)]


def brute_kept(rows, similarity=0.8):
    """Ids that stay if every pair of texts is compared."""
    data = [(i, shingles(t)) for i, t in sorted(rows)]
    low = {i: i for i, _ in data}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, (i, a) in enumerate(data):
        for j, b in data[:k]:
            n = len(a & b)
            if n / (len(a) + len(b) - n) >= similarity:
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i for i, _ in data if find(i) == i}


def test_copies_within_a_bucket_of_others(spark, monkeypatch):
    """Texts of one template are 0.73 to 0.79 alike, those of a pair 0.82: whichever heads their buckets."""
    rows = template_texts(4, edits=8, pairs=60, singles=80, apart=5)
    want = brute_kept(rows)
    assert 130 <= len(want) <= 140
    for size in (near_dedup.BLOCK, 16):
        monkeypatch.setattr(near_dedup, "BLOCK", size)
        assert {r.doc_id for r in near_dedup.without_near_copies(table(spark, rows)).collect()} == want


def test_long_copies_are_measured_whole(spark):
    """Texts of over 512 shingles, 0.802 and 0.796 alike: a sketch can't tell."""
    rng = random.Random(9)
    rows, want = [], set()
    for k in range(24):
        base = words(rng, 1504).split()
        ours, theirs = list(base), list(base)
        # each edit of a word takes five of the 1500 shingles
        for p in rng.sample(range(5, 1499, 5), 33 if k % 2 else 34):
            theirs[p] = "".join(rng.choices("klmnop", k=9))
        rows += [(2 * k, " ".join(ours)), (2 * k + 1, " ".join(theirs))]
        want |= {2 * k} if k % 2 else {2 * k, 2 * k + 1}
    assert brute_kept(rows) == want
    assert {r.doc_id for r in near_dedup.without_near_copies(table(spark, rows)).collect()} == want
