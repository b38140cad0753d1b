"""Mixing sources to target weights: weighted sampling without replacement up to word budgets.

A source's budget comes from its weight. It is met by whole passes over the source first, then by
Efraimidis-Spirakis sampling: each document's key is an exponential variate divided by its quality
weight, documents are taken by ascending key, and a prefix sum of sizes stops at the budget.
Everything is DataFrame expressions. The prefix sum has two levels, over buckets of the key and
within them, so that no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, text_or_empty, written

#: Rows that a bucket of the prefix sum has on average.
BUCKET_ROWS = 4096
#: Classes of the logarithm of a weight to each factor of two, and how many at most on either side of 1.
CLASS_STEPS, CLASSES = 16, 512


def uniform(*parts: Column, seed: int) -> Column:
    """A number in (0, 1) from a digest of ``parts``: equal on every run and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality(text: str) -> Column:
    """Default quality weight: halved for very short texts, and for unusually short or long words."""
    n = F.length(text_or_empty(text))
    words = F.regexp_count(text_or_empty(text), F.lit(WORD))
    mean = n / F.greatest(words, F.lit(1))
    return F.when(words >= 50, 1.0).otherwise(0.5) * F.when(mean.between(4, 11), 1.0).otherwise(0.5)


def source_targets(sources: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """``source, source_size, n_rows`` with ``target``: budgets by weight, none above ``limit`` sizes.

    The excess of capped sources goes to the others by weight until none is above its cap. Ordered
    by cap a unit of weight, a source is capped if the budget left by those before it, dealt over
    the weight left, reaches its cap. One row a source, so the windows here span few rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = sources.withColumn("weight", weight).withColumn("cap", limit * F.col("source_size"))
    w = w.withColumn("all", F.sum("source_size").over(everything).cast("double")).withColumn("every", F.sum("weight").over(everything))
    left = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    over = F.col("every") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("capped", left / over >= F.col("cap") / F.col("weight"))
    rest = F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    share = F.try_divide(rest, F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything))
    return w.withColumn("share", share).select("source", "source_size", "n_rows", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("share") * F.col("weight")).alias("target"))


def decisions(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """How often the mix takes each distinct row.

    Returns ``doc_id, source, digest, size, copies, source_size, target, epochs, chosen``: of
    ``copies`` equal rows all are taken ``epochs`` times and ``chosen`` of them once more.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.md5(text_or_empty(text)).alias("digest"),
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"), (quality(text) if weight is None else weight).alias("w"),
    )
    items = written(rows.groupBy("source", "doc_id", "digest", "size").agg(F.count("*").alias("copies"), F.max("w").alias("w")), "mix-items")
    # by classes of the weight, of which a source has few, then by source
    step = F.greatest(F.lit(-CLASSES), F.least(F.lit(CLASSES), F.round(F.log2(F.greatest("w", F.lit(1e-9))) * CLASS_STEPS)))
    classes = items.groupBy("source", step.alias("step")).agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("n"), F.count("*").alias("k"))
    sources = written(classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_rows"), F.sum("k").alias("n_keys"), F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("step") / CLASS_STEPS).alias("w"), F.col("k").alias("k"))).alias("classes")), "mix-sources")
    targets = written(source_targets(sources, weights, limit).join(sources.select(F.col("source").alias("of"), "n_keys", "classes"), F.col("source").eqNullSafe(F.col("of"))).drop("of"), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest"), seed=seed)
    keyed = items.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("key", -F.log(u) / F.greatest(F.col("w"), F.lit(1e-9)))
    # the share of keys below a key ascends with it and spreads the source's rows over (0, 1)
    below = F.aggregate("classes", F.lit(0.0), lambda total, c: total + c["k"] * (1 - F.exp(-c["w"] * F.col("key")))) / F.col("n_keys")
    buckets = F.ceil(F.col("n_keys") / BUCKET_ROWS)
    keyed = keyed.withColumn("epochs", epochs).withColumn("bucket", F.least(F.floor(below * buckets), buckets)).drop("classes")
    sums = keyed.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("inside"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("inside").over(ahead), F.lit(0)).alias("offset")), "mix-offsets")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).drop("of", "at")
    placed = placed.withColumn("before", F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
    rest = F.col("target") - F.col("epochs") * F.col("source_size") - F.col("before")
    # the row that crosses the budget is taken if that comes nearer to it
    some = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("copies"), F.floor(rest / F.col("size") + 0.5)))).otherwise(F.lit(0))
    return placed.withColumn("chosen", some.cast("long")).select("doc_id", "source", "digest", "size", "copies", "source_size", "target", "epochs", "chosen")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Mix all rows: ``doc_id, size, source_size, target, taken`` (words, repeats counted) a row.

    Size is the number of words (null text: 0). Repeated rows count each; equal keys are ordered by
    id and digest, so that reruns agree. A null source is a source of its own and comes last; a
    null id is kept. A source without words has target 0. No row is dropped: ``taken`` is 0 where
    the mix leaves it out. Other columns aren't read; an empty table gives an empty table.
    """
    d = decisions(docs, **options)
    each = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("copy") <= F.col("chosen"), 1).otherwise(0))
    return each.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row as often as it is taken.

    Rows of equal id, source and text share a decision, whatever their other columns hold: each
    stands once for each epoch, and as many of them as are chosen once more. Null ids, sources and
    texts are kept as they are; a row without words isn't taken. An empty table stays empty.
    """
    d = decisions(docs, doc_id=doc_id, text=text, source=source, **options)
    # only the row that crosses a source's budget has some of its copies chosen and others not
    times = d.where("epochs > 0 or chosen > 0").select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("digest").alias("d"), "copies", "epochs", "chosen")
    mine = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("of"), F.md5(text_or_empty(text)).alias("t"))
    joined = mine.join(times, F.col("id").eqNullSafe(F.col("i")) & F.col("of").eqNullSafe(F.col("s")) & (F.col("t") == F.col("d")))
    split = F.col("chosen").between(1, F.col("copies") - 1)
    even = joined.where(~split).select("row", (F.col("epochs") + F.when(F.col("chosen") > 0, 1).otherwise(0)).alias("n"))
    # these are numbered within the task that wrote them, behind those of the tasks before
    some = written(joined.where(split).select("row", "s", "epochs", "chosen", F.spark_partition_id().alias("task")), "mix-split")
    ahead = Window.partitionBy("s").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = some.groupBy("s", "task").agg(F.count("*").alias("held")).select(F.col("s").alias("at"), F.col("task").alias("by"), F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"))
    placed = some.join(counts, F.col("s").eqNullSafe(F.col("at")) & (F.col("task") == F.col("by")))
    number = F.row_number().over(Window.partitionBy("s", "task").orderBy(F.xxhash64("row"))) + F.col("before")
    rest = placed.select("row", (F.col("epochs") + F.when(number <= F.col("chosen"), 1).otherwise(0)).alias("n"))
    return even.unionByName(rest).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")))).select("row.*")
