"""Quality rules: base statistics of every text, and robust multivariate outliers on top.

Per language and source the centre and scatter of the transformed statistics are estimated by the
minimum covariance determinant: concentration steps keep the ``SHARE`` nearest rows and estimate
again. Texts whose Mahalanobis distance is beyond the cut are rejected. All of it is DataFrame
expressions; a step is two grouped aggregates and a Cholesky factor written out as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written

SHARE, STEPS = 0.75, 4
#: Groups with fewer rows share one estimate, with the smallest other group if they are still fewer;
#: a table with fewer rows in all is judged by the base rule alone.
LEAST_ROWS = 50
#: Bins of the logarithm of the squared distance, in which the SHARE-th nearest row is found.
BINS_A_UNIT = 50
#: Logarithms beyond this on either side count as this.
REACH = 7.0
#: Bins that are counted as one at first.
COARSE = 25
#: Least standard deviation of each transformed statistic. Most texts have no symbol, repeated line or
#: window at all; without it one repeated line, or a table's bars, would be infinitely far from them.
#: Repeated lines reach log1p(100), repeated words log1p(30) before the base rule fails: over 20.5 each.
FLOORS = (0.35, 0.10, 0.50, 0.90, 0.70)
DIMS = len(FLOORS)


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-squared with k degrees of freedom, by its series."""
    term = total = 1 / math.gamma(k / 2 + 1)
    for n in range(1, 400):
        term *= x / 2 / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2) * (x / 2) ** (k / 2)


def chi2_quantile(share: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < share else (low, mid)
    return low


def consistency(share: float, dims: int) -> float:
    """What the scatter of the nearest ``share`` of a normal sample must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, dims), dims + 2)


#: Squared Mahalanobis distance beyond which a text is an outlier: one in a thousand of a normal sample.
CUT = chi2_quantile(0.999, DIMS)


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The base statistics of every whole text, with the group key ``g``."""
    mark = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.concat(mark(lang), F.lit("\x00"), mark(source)).alias("g"))
    t = t.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    t = t.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))
    t = t.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(1), F.size("hashes") - 7), lambda i: F.xxhash64(F.slice("hashes", i, 8)))
    t = t.select(
        "doc_id", "g", F.size("words").cast("long").alias("n_words"), F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("hashes") > 8, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    t = t.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    # only where a window repeats: sorted (hash, place) pairs; equal neighbours give the places that
    # repeat; sorted places give the words covered, 8 each less the overlap with the next
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.withColumn("pairs", F.when(F.col("repeats"), pairs))
    twice = lambda x, k: (x.h == F.get("pairs", k - 1).h) | (x.h == F.get("pairs", k + 1).h)
    places = F.array_sort(F.transform(F.filter("pairs", lambda x, k: F.coalesce(twice(x, k), (x.h == F.get("pairs", k - 1).h), (x.h == F.get("pairs", k + 1).h), F.lit(False))), lambda x: x.i))
    t = t.withColumn("places", places)
    covered = F.aggregate(F.transform("places", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("places", k + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    t = t.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(0).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return t.select("doc_id", "g", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def vector() -> list[Column]:
    """Transformed statistics: shares are taken in parts of a hundred, logarithms tame long tails."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / words),
        F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log1p(100.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(100.0 * F.col("n_repeat_words") / words),
    ]


def names(kind: str) -> list[str]:
    return [f"{kind}{i}{j}" for i in range(DIMS) for j in range(i + 1)]


def estimate(rows: DataFrame, factor: float) -> DataFrame:
    """``g, m0.., l00..``: mean and Cholesky factor of the rows' scatter, floors on the diagonal."""
    sums = [F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMS))]
    sums += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    agg = rows.groupBy("g").agg(*sums)
    # one row of the factor after another, so that each expression refers to columns already there
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") * factor + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            agg = agg.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return agg.select("g", *(f"m{i}" for i in range(DIMS)), *names("l"))


def distances(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance (null where the group has no model)."""
    out = rows.join(model, "g", "left")
    for i in range(DIMS):  # forward substitution
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMS)), F.col("z0") * F.col("z0"))).select(*rows.columns, "d2")


def nearest(scored: DataFrame, share: float) -> DataFrame:
    """The nearest ``share`` of each group, whole bins at a time: exact counts, no sketch.

    A group has as many bins as ``REACH`` allows; those beyond it share the outer ones.
    """
    bin_ = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.log(F.col("d2") + 1e-9))) * BINS_A_UNIT)
    binned = scored.withColumn("bin", bin_)
    counts = written(binned.groupBy("g", "bin").agg(F.count("*").alias("n")), "mcd-bins")
    # coarse bins first, then the fine ones of the coarse bin in which the share is reached
    wide = F.floor(F.col("bin") / COARSE)
    coarse = counts.groupBy("g", wide.alias("c")).agg(F.sum("n").alias("n"))
    upto, whole = Window.partitionBy("g").orderBy("c"), Window.partitionBy("g")
    ranked = coarse.select("g", "c", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all"))
    reached = ranked.where(F.col("upto") >= F.col("all") * share).groupBy("g").agg(F.min(F.struct("c", (F.col("upto") - F.col("n")).alias("before"), "all")).alias("r")).select("g", "r.*")
    fine = counts.withColumn("c", wide).join(reached, ["g", "c"]).select("g", "bin", "all", (F.col("before") + F.sum("n").over(Window.partitionBy("g").orderBy("bin"))).alias("upto"))
    top = written(fine.where(F.col("upto") >= F.col("all") * share).groupBy("g").agg(F.min("bin").alias("top")), "mcd-top")
    return binned.join(top, "g").where("bin <= top").drop("bin", "top")


def quality_rules(docs: DataFrame, *, cut: float = CUT, **columns: str) -> DataFrame:
    """Base statistics of every whole text and the verdict of rules and outliers.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, distance2``, a row for each input row. A null text has no words and fails the base rule;
    null languages and sources are groups of their own; ids may be null or repeat. Groups of fewer
    than ``LEAST_ROWS`` rows are judged together, with the smallest other group if they are too few
    even then; in a table of fewer rows none is an outlier. Rows that fail the base rule take no
    part in the estimates. Other columns aren't read.
    """
    base = written(statistics(docs, **columns), "quality")
    rows = base.where("not base_failed").withColumns({f"x{i}": c for i, c in enumerate(vector())})
    sizes = written(rows.groupBy("g").agg(F.count("*").alias("size")), "mcd-sizes")
    # too few for an estimate even together: the smallest group that has one joins them
    small = F.col("size") < LEAST_ROWS
    left, least = sizes.agg(F.coalesce(F.sum(F.when(small, F.col("size"))), F.lit(0)), F.min(F.when(~small, F.struct("size", "g")))).first()
    joins = F.col("g") == least.g if least and 0 < left < LEAST_ROWS else F.lit(False)
    pooled = F.when(small | joins, F.lit("\x00")).otherwise(F.col("g"))
    groups = written(sizes.select(F.col("g").alias("of"), pooled.alias("to")), "mcd-groups")
    enough = written(sizes.join(groups, sizes.g == groups.of).groupBy("to").agg(F.sum("size").alias("size")).where(F.col("size") >= LEAST_ROWS).select(F.col("to").alias("g")), "mcd-enough")
    at = rows.join(groups, rows.g == groups.of).drop("g", "of").withColumnRenamed("to", "g").select("g", *(f"x{i}" for i in range(DIMS)))
    at = written(at.join(enough, "g", "left_semi"), "mcd-rows")
    # start: medians and floors alone decide what is near
    start = at.groupBy("g").agg(*(F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(DIMS)))
    model = written(start.select("g", *(f"m{i}" for i in range(DIMS)), *(F.lit(FLOORS[int(n[1])] if n[1] == n[2] else 0.0).alias(n) for n in names("l"))), "mcd-0")
    factor = consistency(SHARE, DIMS)
    for step in range(1, STEPS + 1):
        model = written(estimate(nearest(distances(at, model), SHARE), factor), f"mcd-{step}")
    judged = base.join(groups, base.g == groups.of, "left").drop("g", "of").withColumnRenamed("to", "g").withColumns({f"x{i}": c for i, c in enumerate(vector())})
    judged = distances(judged, model)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("d2") > cut, F.lit(False))).alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"),
    )
