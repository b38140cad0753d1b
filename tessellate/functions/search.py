"""Full-text search: term statistics as DataFrames, scores as expressions, a query language.

Texts are cut into lower-case ``\\w+`` tokens. Statistics (documents, average length, document
frequency of the query's terms) come from one pass over the corpus and are as small as the query;
scores are then column expressions without a shuffle.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.expr import col

K1, B = 1.2, 0.75
TOKEN = r"\w+"


def tokens(text: Any) -> Column:
    """Lower-case words of a column or the column of that name."""
    c = F.col(f"`{text}`") if isinstance(text, str) else col(text)
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(TOKEN, query.lower())))


def frequency(column: Column, term: str) -> Column:
    return F.size(F.filter(column, lambda t: t == term))


def weights_of(weights: Any, columns: list[str]) -> list[float]:
    """None: all 1; a shorter list: the rest 0; a mapping: by name, else 0."""
    if weights is None:
        return [1.0] * len(columns)
    if isinstance(weights, dict):
        return [float(weights.get(c, 0)) for c in columns]
    return [float(w) for w in weights] + [0.0] * (len(columns) - len(weights))


class Index:
    """A corpus prepared for a query: token columns and the statistics of its terms."""

    def __init__(self, docs: DataFrame, columns: list[str], query: str):
        self.columns, self.terms = columns, terms_of(query)
        self.docs = docs.withColumns({f"__t_{c}": tokens(c) for c in columns})
        stats = [F.count("*").alias("n")]
        for c in columns:
            stats.append(F.avg(F.size(f"__t_{c}")).alias(f"len_{c}"))
            for k, t in enumerate(self.terms):
                n = frequency(F.col(f"__t_{c}"), t)
                stats += [F.sum((n > 0).cast("long")).alias(f"df_{c}_{k}"), F.sum(n).alias(f"tf_{c}_{k}")]
        self.stats = self.docs.agg(*stats).first().asDict()

    def matched(self, every: bool = True) -> DataFrame:
        """Documents that hold all terms (or any), each in some column."""
        if not self.terms:
            return self.docs.limit(0)
        found = [F.greatest(*(F.array_contains(f"__t_{c}", t) for c in self.columns), F.lit(False)) for t in self.terms]
        test = found[0]
        for f in found[1:]:
            test = (test & f) if every else (test | f)
        return self.docs.where(test)

    def hits(self):
        for j, c in enumerate(self.columns):
            for k, t in enumerate(self.terms):
                yield j, c, k, frequency(F.col(f"__t_{c}"), t)

    def _sum(self, parts: list[Column]) -> Column:
        out = F.lit(0.0)
        for p in parts:
            out = out + p
        return out

    def rank(self, weights: Any = None) -> Column:
        """Minus the weighted sum of hits over all hits."""
        w = weights_of(weights, self.columns)
        return -self._sum([n * w[j] / self.stats[f"tf_{c}_{k}"] for j, c, k, n in self.hits() if self.stats[f"tf_{c}_{k}"]])

    def idf(self, c: str, k: int) -> float:
        import math

        n, df = self.stats["n"], self.stats[f"df_{c}_{k}"] or 0
        return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)

    def bm25(self, weights: Any = None, k1: float = K1, b: float = B) -> Column:
        """Per column, negative; an idf of zero or less counts as 1e-6."""
        w, parts = weights_of(weights, self.columns), []
        for j, c, k, n in self.hits():
            mean = self.stats[f"len_{c}"] or 1.0
            ratio = F.size(f"__t_{c}") / F.lit(float(mean))
            parts.append(self.idf(c, k) * w[j] * (n * (k1 + 1)) / (n + k1 * (1 - b + b * ratio)))
        return -self._sum(parts)

    def bm25f(self, weights: Any = None, k1: float = K1, b: float = B) -> Column:
        """One length over all columns; a term adds its idf even where it doesn't occur."""
        w, parts = weights_of(weights, self.columns), []
        mean = sum(self.stats[f"len_{c}"] or 0 for c in self.columns) or 1.0
        length = F.lit(0)
        for c in self.columns:
            length = length + F.size(f"__t_{c}")
        epsilon = 1 / ((self.stats["n"] or 1) * mean)
        ratio = length / F.lit(float(mean))
        for j, c, k, n in self.hits():
            part = (n * (k1 + 1)) / (n + k1 * (1 - b + b * ratio)) + epsilon
            parts.append(self.idf(c, k) * w[j] * (part + 1))
        return -self._sum(parts)

    def lucene(self, weights: Any = None) -> Column:
        """ln(N / (n + 1)) * sqrt(tf) / sqrt(length); a weight only turns a column on or off."""
        import math

        w, parts = weights_of(weights, self.columns), []
        for j, c, k, n in self.hits():
            if w[j]:
                idf = math.log(self.stats["n"] / ((self.stats[f"df_{c}_{k}"] or 0) + 1)) if self.stats["n"] else 0.0
                parts.append(F.try_divide(F.sqrt(n.cast("double")), F.sqrt(F.size(f"__t_{c}").cast("double"))) * idf)
        return -self._sum([F.coalesce(p, F.lit(0.0)) for p in parts])


def search(docs: DataFrame, columns: list[str], query: str, score: str = "bm25", weights: Any = None) -> DataFrame:
    """Documents that hold every term, with ``score``: smaller is better."""
    index = Index(docs, columns, query)
    return index.matched().withColumn("score", getattr(index, score)(weights)).select(*docs.columns, "score")


def vocabulary(docs: DataFrame, column: str, kind: str = "row") -> DataFrame:
    """``term, doc, cnt``: documents and occurrences of each term; ``instance``: every occurrence."""
    each = docs.select("*", F.posexplode(tokens(column)).alias("offset", "term"))
    if kind == "instance":
        return each
    t = tokens(column)
    once = docs.select(F.explode(F.array_distinct(t)).alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))
    every = docs.select(F.explode(t).alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))
    return once.union(every).groupBy("term").agg(F.sum("d").alias("doc"), F.sum("c").alias("cnt"))


def highlight(text: Any, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    alternatives = "|".join(map(re.escape, terms_of(query))) or r"(?!)"
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col(text), rf"(?iu)\b({alternatives})\b", f"{quote(before)}$1{quote(after)}")


def snippet(text: Any, query: str, size: int = 16, dots: str = "...") -> Column:
    """``size`` words from three before the first hit."""
    w = F.split(col(text), r"\s+")
    terms = F.array(*map(F.lit, terms_of(query)))
    flags = F.transform(w, lambda x: F.arrays_overlap(tokens(x), terms))
    first = F.greatest(F.array_position(flags, True) - 3, F.lit(1)).cast("int")
    cut = F.array_join(F.slice(w, first, size), " ")
    return F.concat(F.when(first > 1, F.lit(dots)).otherwise(F.lit("")), cut, F.when(first + size <= F.size(w), F.lit(dots)).otherwise(F.lit("")))


def clean_query(query: str, replacement: str = "\x1a") -> str:
    """Characters that aren't part of the query language replaced."""
    out, quoted = [], False
    for c in query:
        if c == '"':
            quoted = not quoted
        out.append(c if quoted or c == '"' or c.isalnum() or c in " _*+():^-" or ord(c) > 127 else replacement)
    return "".join(out)


def validate_query(query: str) -> bool:
    return "\x1a" not in clean_query(query) and query.count('"') % 2 == 0


LEXER = re.compile(r'\s*(?:(?P<phrase>-?"[^"]*")|(?P<open>\()|(?P<close>\))|(?P<word>[^\s()"]+))')


class WebQuery:
    """A search box's language: words and phrases (all), OR, AND, NOT or -, column:, parentheses."""

    def __init__(self, text: str, columns: list[str]):
        self.items = [m for m in LEXER.finditer(text.strip())] if text.strip() else []
        self.columns, self.at = columns, 0

    def _peek(self) -> str | None:
        return self.items[self.at].group(0).strip() if self.at < len(self.items) else None

    def parse(self) -> Column:
        out = self._or()
        return F.lit(False) if out is None else out

    def _or(self) -> Column | None:
        left = self._and()
        while self._peek() == "OR":
            self.at += 1
            right = self._and()
            left = right if left is None else left if right is None else left | right
        return left

    def _and(self) -> Column | None:
        out = None
        while (token := self._peek()) is not None and token not in ("OR", ")"):
            if token == "AND":
                self.at += 1
                continue
            part = self._term()
            out = part if out is None else out if part is None else out & part
        return out

    def _term(self) -> Column | None:
        token = self._peek()
        self.at += 1
        if token == "NOT":
            part = self._term() if self._peek() not in (None, ")") else None
            return None if part is None else ~part
        if token == "(":
            inner = self._or()
            if self._peek() == ")":
                self.at += 1
            return inner
        negative = token.startswith("-") and len(token) > 1
        token = token[1:] if negative else token
        columns = self.columns
        name, colon, rest = token.partition(":")
        if colon and name in self.columns:
            columns, token = [name], rest or (self._peek() or "")
            if not rest:
                self.at += 1
        test = self._match(token, columns)
        return ~test if negative and test is not None else test

    def _match(self, token: str, columns: list[str]) -> Column | None:
        words = re.findall(r"\w+", token.lower())
        if not words:
            return None
        prefix = token.endswith("*")
        found = F.lit(False)
        for c in columns:
            t = tokens(c)
            if len(words) == 1:
                found = found | (F.exists(t, lambda x: x.startswith(words[0])) if prefix else F.array_contains(t, words[0]))
            else:
                found = found | F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")).contains(f" {' '.join(words)} ")
        return found


def web_query(text: str, columns: list[str]) -> Column:
    return WebQuery(text, columns).parse()
