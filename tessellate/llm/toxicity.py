"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels are given for documents; tokens are labelled from them: in a toxic document a token is toxic
whose word, or whose beginning, hardly occurs in documents that aren't. The field has two states,
weights for words and beginnings, and transitions; it is trained by gradient ascent on a bounded
sample. Forward-backward marginals give the offending spans and, through a logistic fit on the
largest marginal and their sum, a document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Documents of each class that the sample has at most.
SAMPLE = 500
#: Lengths in characters of the beginnings that serve as features.
STEMS = (4, 5, 6)
#: Share of toxic documents, classes weighed alike, among those a feature must occur in.
LEAST_SHARE = 0.95
#: Features that may pass by chance alone.
BY_CHANCE = 0.01
#: Overlap of words from which two documents of the sample count as copies.
COPIES = 0.5
STEPS, RATE, DECAY = 40, 0.5, 1e-4
#: Marginals below this don't add up, however many a long text has.
FAINT = 0.1
CACHE = 300_000
BLOCK = 128
#: A-Z in lower case; ASCII that is neither letter nor digit parts tokens.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def features(word: bytes) -> list[str]:
    """The word itself and its beginnings."""
    w = word.decode("utf-8", "replace").lower()
    return ["=" + w, *(w[:n] for n in STEMS if len(w) >= n)]


def chain(em: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors of all documents' tokens in one chain.

    ``first`` marks tokens that begin a document; their step forgets the state before, so that
    documents don't touch. The chain is cut into blocks whose steps run side by side: products of
    the blocks' transfer matrices carry the state from block to block.
    """
    n = len(em)
    rows = -(-n // BLOCK)
    e = np.ones(rows * BLOCK)
    e[:n] = np.exp(np.clip(em, -30, 30))
    f = np.ones(rows * BLOCK, bool)
    f[:n] = first
    e, f = e.reshape(rows, BLOCK), f.reshape(rows, BLOCK)
    # entries of each step's matrix: from state i to state j
    m00, m10 = np.where(f, start[0], trans[0, 0]), np.where(f, start[0], trans[1, 0])
    m01, m11 = np.where(f, start[1], trans[0, 1]) * e, np.where(f, start[1], trans[1, 1]) * e
    p = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(BLOCK):
        a, b, c, d = p
        x, y, z, w = m00[:, k], m01[:, k], m10[:, k], m11[:, k]
        p = a * x + b * z, a * y + b * w, c * x + d * z, c * y + d * w
        s = p[0] + p[1] + p[2] + p[3]
        p = tuple(v / s for v in p)
    a0, a1 = np.empty(rows), np.empty(rows)
    x, y = 1.0, 0.0
    pa_, pb, pc, pd = (v.tolist() for v in p)
    for r in range(rows):
        a0[r], a1[r] = x, y
        x, y = x * pa_[r] + y * pc[r], x * pb[r] + y * pd[r]
        s = x + y
        x, y = x / s, y / s
    b0, b1 = np.empty(rows), np.empty(rows)
    x = y = 0.5
    for r in range(rows - 1, -1, -1):
        b0[r], b1[r] = x, y
        x, y = pa_[r] * x + pb[r] * y, pc[r] * x + pd[r] * y
        s = x + y
        x, y = x / s, y / s
    alpha0, alpha1, beta0, beta1 = (np.empty((rows, BLOCK)) for _ in range(4))
    for k in range(BLOCK):
        a0, a1 = a0 * m00[:, k] + a1 * m10[:, k], a0 * m01[:, k] + a1 * m11[:, k]
        s = a0 + a1
        a0, a1 = a0 / s, a1 / s
        alpha0[:, k], alpha1[:, k] = a0, a1
    for k in range(BLOCK - 1, -1, -1):
        beta0[:, k], beta1[:, k] = b0, b1
        b0, b1 = m00[:, k] * b0 + m01[:, k] * b1, m10[:, k] * b0 + m11[:, k] * b1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
    return tuple(v.reshape(-1)[:n] for v in (alpha0, alpha1, beta0, beta1))


def marginals(em: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each token."""
    if not len(em):
        return em
    a0, a1, b0, b1 = chain(em, first, trans, start)
    return a1 * b1 / (a0 * b0 + a1 * b1)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.ones(2))
    logit: tuple[float, float, float] = (-5.0, 0.0, 0.0)
    cache: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        try:
            return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            for w in set(words):
                if w not in cache:
                    cache[w] = self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
            return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))

    def token_marginals(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        size = np.array([len(d) for d in docs], np.int64)
        em = np.concatenate([np.zeros(0), *(self.emissions(d) for d in docs)])
        first = np.zeros(len(em), bool)
        begin = np.cumsum(size) - size
        first[begin[size > 0]] = True
        p = marginals(em, first, self.trans, self.start)
        return [p[b : b + n] for b, n in zip(begin.tolist(), size.tolist())]

    def score(self, p: np.ndarray) -> float:
        a, b, c = self.logit
        z = a + b * float(p.max(initial=0.0)) + c * float(np.log1p(p[p >= FAINT].sum()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def spans(self, text: bytes, p: np.ndarray) -> list[dict]:
        """Character offsets of runs of tokens that are likelier toxic than not."""
        hot = set(np.flatnonzero(p >= 0.5).tolist())
        if not hot:
            return []
        out, last = [], -2
        for k, m in enumerate(re.finditer(rb"\S+", text.translate(TABLE))):
            if k in hot:
                begin, end = (len(text[:x].decode("utf-8", "replace")) for x in m.span())
                if last == k - 1:
                    out[-1]["end"] = end
                else:
                    out.append({"begin": begin, "end": end})
                last = k
        return out


def independent(docs: list[list[bytes]]) -> list[int]:
    """Documents that are no copy of an earlier one: copies would pass their words off as frequent."""
    kept, holders, sizes = [], {}, {}
    for k, d in enumerate(docs):
        words = set(d)
        # a fixed eighth of all words stands for those of longer documents
        mine = {w for w in words if len(words) < 64 or zlib.crc32(w) % 8 == 0}
        shared = Counter(h for w in mine for h in holders.get(w, ()))
        if any(n >= COPIES * (len(mine) + sizes[h] - n) for h, n in shared.items()):
            continue
        kept.append(k)
        sizes[k] = len(mine)
        for w in mine:
            holders.setdefault(w, []).append(k)
    return kept


def marked_features(docs: list[list[bytes]], labels: list[int]) -> set[str]:
    """Words and beginnings that toxic documents have and others hardly do, beyond chance."""
    n1, n0 = sum(labels), len(labels) - sum(labels)
    if not n1 or not n0:
        return set()
    toxic, clean = Counter(), Counter()
    by_word: dict[str, Counter] = {}
    for d, y in zip(docs, labels):
        words = set(d)
        seen = {f for w in words for f in features(w)}
        (toxic if y else clean).update(seen)
        for w in words:
            for f in features(w)[1:]:
                by_word.setdefault(f, Counter())[w] += 1
    # in how many toxic documents a feature must occur, so that few of as frequent ones do by chance
    frequent = np.bincount(list((toxic + clean).values()))[::-1].cumsum()[::-1]
    least = next((k for k in range(2, len(frequent)) if frequent[k] * (n1 / (n1 + n0)) ** k <= BY_CHANCE), len(frequent))
    telling = lambda t, c: t >= least and t / n1 >= LEAST_SHARE * (t / n1 + c / n0)
    marks = {f for f, t in toxic.items() if f[0] == "=" and telling(t, clean[f])}
    # a beginning counts only if it still tells without its most frequent word
    asked = {f: max(words.items(), key=lambda x: (x[1], x[0]))[0] for f, words in by_word.items() if len(words) >= 3 and telling(toxic[f], clean[f])}
    rest: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for d, y in zip(docs, labels):
        rest[bool(y)].update({f for w in set(d) for f in features(w)[1:] if asked.get(f, w) != w})
    return marks | {f for f in asked if telling(rest[True][f], rest[False][f])}


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Fit the field and the score on labelled documents. Without both classes all scores are low."""
    model = Model()
    docs = [tokens(t) for t in texts]
    own = independent(docs)
    docs, labels = [docs[k] for k in own], [labels[k] for k in own]
    marks = marked_features(docs, labels)
    if not marks:
        return model
    known = {f: k for k, f in enumerate(sorted(marks))}
    none, width = len(known), 1 + len(STEMS)
    by_word: dict[bytes, tuple] = {}

    def ids(w: bytes) -> tuple:
        if (x := by_word.get(w)) is None:
            found = [known[f] for f in features(w) if f in known]
            x = by_word[w] = tuple(found + [none] * (width - len(found)))
        return x

    flat = np.array([ids(w) for d in docs for w in d], np.int64).reshape(-1, width)
    size = np.array([len(d) for d in docs])
    y = (flat[:, 0] != none) & np.repeat(np.array(labels, bool), size)
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(size) - size)[size > 0]] = True
    w, bias, trans, start = np.zeros(none + 1), -2.0, np.zeros((2, 2)), np.zeros(2)
    inner = np.flatnonzero(~first)
    gold = np.array([[(~y[inner - 1] & ~y[inner]).sum(), (~y[inner - 1] & y[inner]).sum()], [(y[inner - 1] & ~y[inner]).sum(), (y[inner - 1] & y[inner]).sum()]], float)
    gold_start = np.array([(~y[first]).sum(), y[first].sum()], float)
    count = np.bincount(flat.ravel(), minlength=none + 1).astype(float) + 1
    want = np.bincount(flat[y].ravel(), minlength=none + 1)
    for _ in range(STEPS):
        em, t, s = bias + w[flat].sum(axis=1), np.exp(trans), np.exp(start)
        a0, a1, b0, b1 = chain(em, first, t, s)
        p = a1 * b1 / (a0 * b0 + a1 * b1)
        e = np.exp(np.clip(em[inner], -30, 30))
        pair = np.stack([a0[inner - 1] * t[0, 0] * b0[inner], a0[inner - 1] * t[0, 1] * e * b1[inner], a1[inner - 1] * t[1, 0] * b0[inner], a1[inner - 1] * t[1, 1] * e * b1[inner]])
        pair = (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
        # each parameter's step is its gradient over the tokens it stands in
        grad = (want - np.bincount(flat.ravel(), np.repeat(p, width), minlength=none + 1)) / count
        grad[none] = 0
        w += RATE * (10 * grad - DECAY * w)
        bias += RATE * 10 * float((y - p).sum()) / max(1.0, float(y.sum() + p.sum()))
        trans += RATE * (gold - pair) / (gold + pair + 1)
        start += RATE * (gold_start - np.array([(1 - p[first]).sum(), p[first].sum()])) / (gold_start + 1)
    model.weights = {f: float(w[k]) for f, k in known.items()}
    model.bias, model.trans, model.start = float(bias), np.exp(trans), np.exp(start)
    ps = model.token_marginals(docs)
    x = np.array([[1.0, p.max(initial=0.0), np.log1p(p[p >= FAINT].sum())] for p in ps])
    target, b = np.array(labels, float), np.zeros(3)
    for _ in range(25):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        b += np.linalg.solve(h, x.T @ (target - q) - 0.1 * b)
    model.logit = tuple(map(float, b))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees; a null id is none of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents of each class, chosen by a digest of their ids.

    The sample is the only thing that reaches the driver; its size is the bound of the broadcast.
    Labels of held-out ids, null labels and labels without a document are left out.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y")).where(~held_out("i"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t")).join(chosen, "i").select("i", "t", "y").collect()
    rows.sort(key=lambda r: (r.i, bytes(r.t)))
    return train([bytes(r.t) for r in rows], [r.y for r in rows])


def toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text: ``doc_id, score, spans`` (character offsets of toxic runs).

    A row for each input row, repeated rows included; null and empty texts have no tokens and get
    the score of none. Null ids stay; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[1].to_pylist()
            ps = model.token_marginals([tokens(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b[0], pa.array([model.score(p) for p in ps], pa.float64()), pa.array([model.spans(t, p) for t, p in zip(texts, ps)], span)], ["doc_id", "score", "spans"])

    raw = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    return raw.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<begin:long,end:long>>")


def without_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; columns as they were."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = model.token_marginals([tokens((t or "").encode()) for t in b[at].to_pylist()])
            yield b.filter(pa.array([model.score(p) < threshold for p in ps], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
