"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is any window of consecutive words, ``SPAN`` times as long as a template's token set. The
join finds every block that contains at least ``threshold`` of a template's tokens. Tokens are
ordered by their document frequency over the whole corpus, rarest first. A block that meets the
threshold holds one of the first ``n - ceil(threshold * n) + 1`` tokens in that order (prefix
filter), a text has at least ``ceil(threshold * n)`` words (length filter), and its template tokens
must lie close enough (positional filter); what passes is counted exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Words are [a-z0-9] and what isn't ASCII; A-Z in lower case, everything else parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "licensed under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike license"),
    ("proprietary", "no part of this publication may be reproduced or transmitted in any form without prior written permission"),
)
SPAN = 1.5


class Scanner:
    """Phrases and templates prepared for a frequency order of tokens."""

    def __init__(self, phrases: dict[str, str], templates, threshold: float, frequency: dict[str, int]):
        self.phrases = [(b" " + p.encode() + b" ", p.count(" ") + 1, label) for p, label in phrases.items()]
        self.templates, self.prefix = [], {}
        for k, (label, text) in enumerate(templates):
            tokens = sorted({t.encode() for t in text.split()}, key=lambda t: (frequency.get(t.decode(), 0), t))
            need = math.ceil(threshold * len(tokens) - 1e-9)
            self.templates.append((label, frozenset(tokens), need, math.ceil(SPAN * len(tokens))))
            for t in tokens[: len(tokens) - need + 1]:
                self.prefix.setdefault(t, []).append(k)
        self.rare = frozenset(self.prefix)

    def places(self, flat: bytes, phrase: bytes) -> list[int]:
        """Word indexes at which a phrase's words stand, overlapping places included."""
        at, found = flat.find(phrase), []
        while at >= 0:
            found.append(at)
            at = flat.find(phrase, at + 1)
        if not found:
            return []
        words, last, out = 0, 0, []
        for at in found:
            words += flat.count(b" ", last, at)
            last = at
            out.append(words)
        return out

    def stretches(self, words: list[bytes], present: set[bytes], k: int) -> list[tuple[int, int, float]]:
        """Maximal stretches of overlapping or adjoining blocks that hold template k: first word, end, highest containment.

        Blocks lie within the text; a text shorter than a block is one block.
        """
        _, tokens, need, span = self.templates[k]
        if len(words) < need or len(tokens & present) < need:
            return []
        where = [i for i, w in enumerate(words) if w in tokens]
        last = max(0, len(words) - span)
        # the tokens inside a block change only where one enters or leaves
        steps = sorted({0, *(i - span + 1 for i in where if 0 < i - span + 1 <= last), *(i + 1 for i in where if i < last)})
        inside: Counter = Counter()
        left = right = 0
        out: list[tuple[int, int, float]] = []
        for begin, after in zip(steps, [*steps[1:], last + 1]):
            while right < len(where) and where[right] < begin + span:
                inside[words[where[right]]] += 1
                right += 1
            while left < right and where[left] < begin:
                w = words[where[left]]
                inside[w] -= 1
                if not inside[w]:
                    del inside[w]
                left += 1
            if len(inside) < need:
                continue
            end, share = min(len(words), after - 1 + span), len(inside) / len(tokens)
            if out and out[-1][1] >= begin:
                out[-1] = (out[-1][0], end, max(out[-1][2], share))
            else:
                out.append((begin, end, share))
        return out

    def scan(self, text: bytes) -> dict:
        words = text.translate(TABLE).split()
        flat = b" " + b" ".join(words) + b" "
        hits = [(p, label) for phrase, _, label in self.phrases for p in self.places(flat, phrase)]
        base = {label for _, label in hits}
        labels, score = set(base), 1.0 if base else 0.0
        present = self.rare.intersection(words)
        blocks = []
        if present:
            every = set(words)
            for k in sorted({k for t in present for k in self.prefix[t]}):
                for begin, end, share in self.stretches(words, every, k):
                    labels.add(self.templates[k][0])
                    blocks.append({"label": self.templates[k][0], "word": begin, "end": end, "containment": share})
                    score = max(score, share)
        at = [p for p, _ in hits]
        return {"n_words": len(words), "n_base": len(hits), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "blocks": blocks}


def _raw(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))


def token_frequency(docs: DataFrame, templates=TEMPLATES, *, doc_id: str = "doc_id", text: str = "text") -> dict[str, int]:
    """Documents of the whole corpus that hold each template token: as many rows as the templates' vocabulary."""
    small_batches(docs.sparkSession)
    vocabulary = frozenset(t.encode() for _, x in templates for t in x.split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b[0].to_pylist():
                seen.update(vocabulary.intersection(t.translate(TABLE).split()))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    rows = _raw(docs, doc_id, text).select("t").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in rows.collect()}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,word:long,end:long,containment:double>>"


def license_scan(docs: DataFrame, *, phrases: dict[str, str] | None = None, templates=TEMPLATES, threshold: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan every whole text for phrases and template blocks.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``,
    a row for each input row, repeated rows included. ``score`` is 1 with a phrase, else the highest
    containment that meets the threshold, else 0. ``blocks`` has every
    maximal stretch of overlapping or adjoining blocks that meet the threshold, by template and place:
    first word, end (exclusive) and the highest containment of a block in it. A null text counts as empty: no words,
    null places, empty labels, score 0. Null ids stay; other columns aren't read.
    """
    frequency = token_frequency(docs, templates, doc_id=doc_id, text=text)
    scanner = Scanner(PHRASES if phrases is None else phrases, templates, threshold, frequency)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), block]
        for b in batches:
            found = [scanner.scan(t) for t in b[1].to_pylist()]
            keys = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
            yield pa.RecordBatch.from_arrays([b[0], *(pa.array([x[k] for x in found], t) for k, t in zip(keys, kinds))], ["doc_id", *keys])

    return _raw(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def brute_blocks(text: str, templates=TEMPLATES, threshold: float = 0.9) -> set[str]:
    """Labels found by looking at every window of words: for tests."""
    words, out = text.encode().translate(TABLE).split(), set()
    for label, x in templates:
        tokens = {t.encode() for t in x.split()}
        need, span = math.ceil(threshold * len(tokens) - 1e-9), math.ceil(SPAN * len(tokens))
        if any(len(tokens.intersection(words[i : i + span])) >= need for i in range(max(1, len(words)))):
            out.add(label)
    return out


def brute_stretches(text: str, templates=TEMPLATES, threshold: float = 0.9) -> list[tuple[str, int, int, float]]:
    """Stretches found by looking at every window of words: for tests."""
    words, out = text.encode().translate(TABLE).split(), []
    for label, x in templates:
        tokens = {t.encode() for t in x.split()}
        need, span = math.ceil(threshold * len(tokens) - 1e-9), math.ceil(SPAN * len(tokens))
        covered, top = [False] * len(words), [0.0] * len(words)
        for i in range(max(0, len(words) - span) + 1):
            n = len(tokens.intersection(words[i : i + span]))
            if n >= need:
                for j in range(i, min(len(words), i + span)):
                    covered[j], top[j] = True, max(top[j], n / len(tokens))
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and covered[j]:
                j += 1
            if j > i:
                out.append((label, i, j, max(top[i:j])))
            i = j + 1
    return sorted(out)
