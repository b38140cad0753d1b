"""Token counts: byte-pair merging of whole batches at once, without a tokenizer library.

Texts are cut at spaces, and each distinct chunk, its space before it, into pre-tokens by the
vocabulary's own pattern (a pre-token never reaches over a space followed by a non-space). Pre-tokens
that a worker hasn't met are held as one ragged array of symbol ids. In each round every sequence finds the pair of its
lowest rank and merges all occurrences of it at once; sequences that have no pair left drop out.
The number of symbols that survive is the pre-token's token count, kept in a bounded cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers; beyond it the cache starts anew.
CACHE = 500_000
#: Pre-tokens of one ragged array, and chunks held until new ones among them are merged.
ROUND, HELD = 20_000, 400_000
#: Mark of a chunk that begins with white space: what it counts depends on its neighbour.
UNSURE = -(10**15)
NONE = np.uint32(0xFFFFFFFF)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


class Merger:
    """Ranks of a byte-level BPE vocabulary and the rank-synchronous merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = 21
        keys = left << np.uint64(32) | right
        # open addressing, filled in rounds: in each, one key takes each free slot that is wanted
        self.table = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << self.bits, NONE, np.uint32)
        self.merged = np.zeros(1 << self.bits, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.rank[slot] == NONE
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            at = slot[put]
            self.table[at], self.rank[at], self.merged[at] = keys[todo[put]], todo[put], merged[todo[put]]
            left_over = np.ones(len(todo), bool)
            left_over[put] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & ((1 << self.bits) - 1)
        self.counts: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such pair) and slot of each pair."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = np.where(self.table[slot] == keys, self.rank[slot], NONE)
        open_ = np.flatnonzero((found == NONE) & (self.rank[slot] != NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.table[slot[open_]] == keys[open_]
            found[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (self.rank[slot[open_]] != NONE)]
        return found, slot

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each byte string, all merged together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), size)
        counts = size.copy()
        while len(sym) > 1:
            same = seq[1:] == seq[:-1]
            rank, slot = self.lookup(sym[:-1], sym[1:])
            rank[~same] = NONE
            begin = np.flatnonzero(np.r_[True, ~same])
            low = np.minimum.reduceat(np.r_[rank, NONE], begin)
            own = np.repeat(low, np.diff(np.r_[begin, len(sym)]))
            hit = np.flatnonzero((rank == own[:-1]) & (rank != NONE))
            if not len(hit):
                break
            # in a run of overlapping hits (a a a) every other one merges, from the left
            run = np.r_[True, np.diff(hit) != 1]
            at = np.arange(len(hit))
            hit = hit[(at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0]
            sym[hit] = self.merged[slot[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            counts -= np.bincount(seq[hit], minlength=len(words))
            live = own != NONE
            keep &= live
            sym, seq = sym[keep], seq[keep]
        return counts

    def learn(self, tokens: set[str]) -> None:
        new = list(tokens)
        for i in range(0, len(new), ROUND):
            part = new[i : i + ROUND]
            self.counts.update(zip(part, self.lengths([t.encode() for t in part]).tolist()))


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def count_texts(texts: list[str | None], vocabulary: str, special: bool = True) -> list[int]:
    """Tokens of each text. ``special``: the vocabulary's special strings are one token each."""
    import regex

    m = merger(vocabulary)
    find = _patterns.setdefault("pre", regex.compile(PATTERN)).findall
    cut = _patterns.setdefault(vocabulary, regex.compile("|".join(map(regex.escape, m.special)) or r"(?!)"))
    out, held, whole, size = [], [], [], 0

    def pretokens(lists: list[list[str]]) -> list[int]:
        """Tokens of each list; new pre-tokens of all of them are merged together."""
        if len(m.counts) > CACHE:
            m.counts.clear()
        m.learn({t for tokens in lists for t in tokens if t not in m.counts})
        return [sum(map(m.counts.__getitem__, tokens)) for tokens in lists]

    def settle() -> None:
        if len(m.chunks) > CACHE:
            m.chunks.clear()
        # a first chunk has no space before it; the others are counted with theirs, each once
        new = {c for _, chunks in held for c in chunks[1:]}.difference(m.chunks)
        m.chunks.update((c, UNSURE) for c in new if not c or c[0].isspace())
        new = [c for c in new if c and not c[0].isspace()]
        if new:
            tokens = find(" " + " ".join(new))
            begin = [k for k, t in enumerate(tokens) if t[0] == " "]  # no other token begins with a space
            if len(m.counts) > CACHE:
                m.counts.clear()
            m.learn(set(tokens).difference(m.counts))
            counts = np.fromiter(map(m.counts.__getitem__, tokens), np.int64, len(tokens))
            m.chunks.update(zip(new, np.add.reduceat(counts, begin).tolist()))
        for (k, chunks), n in zip(held, pretokens([find(chunks[0]) for _, chunks in held])):
            n += sum(map(m.chunks.__getitem__, chunks[1:]))
            if n < 0:  # white space meets across a cut: by the whole text
                whole.append(k)
            else:
                out[k] += n
        for k in whole:
            for tokens in _pieces(find, texts[k]):
                out[k] += pretokens([tokens])[0]
        held.clear()
        whole.clear()

    for k, text in enumerate(texts):
        text = text or ""
        out.append(0)
        if special and any(s in text for s in m.special):
            parts = cut.split(text)
            out[k] = len(parts) - 1
            for part in parts:
                for tokens in _pieces(find, part):
                    out[k] += pretokens([tokens])[0]
            continue
        chunks = text.split(" ")
        held.append((k, chunks))
        size += len(chunks)
        if size > HELD:
            settle()
            size = 0
    settle()
    return out


_patterns: dict = {}


def _pieces(find, text: str, step: int = 1 << 20) -> Iterator[list[str]]:
    """Pre-tokens, in lists of bounded size: a long text is cut before a space that follows a non-space."""
    import re

    at = 0
    while len(text) - at > step:
        cut = re.compile(r"(?<=\S)(?= \S)").search(text, at + step)
        if not cut:
            break
        yield find(text[at : cut.start()])
        at = cut.start()
    yield find(text[at:] if at else text)


def token_counts(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Count the tokens of every whole text.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``, a row for each input row, repeated rows
    included. A null text counts as empty (0 bytes, 0 tokens); a null id stays null; other columns,
    whatever their names, are not read. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(count_texts(b[2].to_pylist(), vocabulary), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    # the length in bytes is the JVM's; only the text itself goes to Python
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
