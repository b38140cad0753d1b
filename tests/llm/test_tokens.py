import io
import zlib

import numpy as np
import pytest
from helpers import awkward, table

from tessellate.llm import token_counts, token_output
from tessellate.llm.queries import QUERIES, vocabulary

tokenizers = pytest.importorskip("tokenizers")


def test_counts_equal_the_library(spark):
    path = vocabulary("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = awkward() + [(200, "aaaaaaa  \n\n \t x's We'll 1234567 ½ ²³ — “quoted”  end\r\n"), (201, " " * 50 + "\n" * 9), (202, "\x1c\x1d a \x85b​")]
    got = token_counts.token_counts(table(spark, rows), path).collect()
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_counts_of_a_whole_table(spark, sf):
    lib = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, sf).collect()} == want


def test_long_text_in_pieces():
    find = __import__("regex").compile(token_counts.PATTERN).findall
    text = "ab  cd\n\n ef  gh " * 50
    assert [t for p in token_counts._pieces(find, text, 37) for t in p] == find(text)


def test_empty_tables(spark):
    assert token_counts.token_counts(table(spark, []), vocabulary("byte_bpe_50k.json")).collect() == []
    assert token_output.token_output(table(spark, []), vocabulary("word_bpe_49k.json")).collect() == []


def brute_output(rows):
    lib = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_output_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_DOCS", 5)
    seen, rows = set(), []
    for i, t in awkward() + [(300, "é é ΣΑΣ İ ǅ x a b 'S don'T \x1c x\x85y")]:
        if i is not None and i not in seen:
            seen.add(i)
            rows.append((i, t))
    got = sorted(tuple(r) for r in token_output.token_output(table(spark, rows), vocabulary("word_bpe_49k.json")).collect())
    assert got == brute_output(rows)


def test_output_keeps_null_ids_and_repeats(spark):
    rows = awkward()
    got = token_output.token_output(table(spark, rows), vocabulary("word_bpe_49k.json")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_output_of_a_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r)[:4] for r in QUERIES["op4_token_output"](spark, sf).collect()) == brute_output(rows)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 9000])
@pytest.mark.parametrize("step", [1, 500, 2**50])
def test_elias_fano(n, step):
    rng = np.random.default_rng(n)
    values = np.cumsum(rng.integers(0, step, n).astype(np.uint64), dtype=np.uint64)
    blob = token_output.EliasFano.encode(values)
    ef = token_output.EliasFano(n, int(values[-1]) if n else 0, lambda at, size: blob[at : at + size])
    assert ef.size == len(blob) and np.array_equal(ef.select(0, n), values)
    for a, b in [(0, 1), (n // 2, n), (n // 3, n // 3 + 70), (63, 65), (n - 1, n)]:
        a, b = max(0, min(a, n)), min(b, n)
        assert ef.select(a, b).tolist() == values[a:b].tolist()
    if n >= 1000 and step == 500:
        assert len(blob) < 2 * n


def test_a_shard_is_read_in_ranges():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 40, 700)
    ends, none = np.cumsum(sizes), token_output.NONE
    docs = np.r_[[none] * 5, np.sort(rng.integers(-(2**62), 2**62, 690)), [2**62] * 5]
    ids = rng.integers(0, 2**16, ends[-1]).astype("<u2")
    blob = b"".join(token_output.pack(docs, ends, ids.tobytes(), 2))
    shard = token_output.TokenShard(io.BytesIO(blob))
    assert len(blob) - 2 * len(ids) < 700 * 10
    for a, b in [(0, 700), (0, 3), (3, 9), (5, 70), (699, 700)]:
        assert np.array_equal(shard.doc_ids(a, b), docs[a:b])
        at = shard.bounds(a, b)
        assert np.array_equal(np.diff(at), sizes[a:b]) and at[0] == ends[a] - sizes[a]
        assert np.array_equal(shard.ids(int(at[0]), int(at[-1])), ids[at[0] : at[-1]])
    with pytest.raises(ValueError):
        token_output.TokenShard(io.BytesIO(b"x" * 100))
