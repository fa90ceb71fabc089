"""Operator 3, mixing sources to target weights, in DataFrame operations only.

Efraimidis-Spirakis sampling: each document draws an exponential key scaled by its quality
weight; within a source, documents are taken in key order until the prefix sum of their sizes
reaches the source's budget. Whole epochs come first, the rest of the budget is the
fractional selection.

The prefix sum never sorts a source in one task: keys fall into BUCKETS ranges, the ranges' sums
give every range's offset, the one range that the budget ends in is cut into BUCKETS ranges
again, whatever weights crowd it, and only the one of these where the budget ends is sorted.

Defined results: null or empty texts have size 0 and take nothing; a null source is a source,
ordered last; an unlabelled document has weight 1; rows equal in doc_id, source and size are
interchangeable; a row without doc_id draws by its text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.common import by_sorting, count_words, materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BUCKETS = 4096
SEED = "mix-1"


def draw(doc_id: str, text: str, seed: str = SEED) -> Column:
    """-ln(u) with u in (0, 1) from the digest of doc_id, or of the text where that is null: divided
    by the weights, the smallest keys are an Efraimidis-Spirakis sample. Reruns agree."""
    instead = F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), instead), F.lit(seed)))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u)


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to (source, source_size): weights repeat along the sources in code point
    order, null last; a target stops at most * source_size and the excess is shared again by
    weight. There is one row a source, so its windows are small.

    With ratio = most * size / weight, the sources that reach their stop are the first few by
    ratio; level is what one unit of weight gets once these are paid."""
    everyone = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy("ratio", "rank")
    rank = F.row_number().over(everyone) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sources.withColumn("rank", rank).withColumn("weight", weight)
    s = s.withColumn("stop", most * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("weight"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("paid", F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    every = W.partitionBy(F.lit(1))
    s = s.withColumn("level", (share * F.sum("source_size").over(every) - F.col("paid")) / F.col("weight_left"))
    # The first source whose stop lies above its level, and all after it, get that level.
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)
    s = s.withColumn("first", first)
    open_ = F.struct("ratio", "rank") >= F.struct("first.ratio", "first.rank")
    target = F.when(open_, F.col("first.level") * F.col("weight")).otherwise(F.col("stop"))
    return s.withColumn("target", F.coalesce(target, F.col("stop"))).select("source", "source_size", "target")


def _ends(sums: DataFrame, plan: DataFrame) -> DataFrame:
    """sums: source, bucket, sum; plan: source, source_size, target, epochs, rest, start (words
    before the first bucket). Adds end: the bucket that the budget ends in, and the words before it."""
    walk = W.partitionBy("r_source").orderBy("bucket")
    ranges = sums.withColumnRenamed("source", "r_source").withColumn("upto", F.sum("sum").over(walk))
    met = ranges.join(plan, F.col("r_source").eqNullSafe(F.col("source"))).filter(F.col("start") + F.col("upto") >= F.col("rest"))
    end = F.min(F.struct("bucket", (F.col("start") + F.col("upto") - F.col("sum")).alias("before"))).alias("end")
    return met.groupBy("source", "source_size", "target", "epochs", "rest").agg(end)


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """docs: doc_id, text, source; quality: (doc_id, weight) with positive weights. One row per
    row of docs: doc_id, source, size, source_size, target, epochs (complete copies), part (words
    of the fractional selection; the document where a budget ends gives only what is left) and taken."""
    # The texts end here, before the join: beyond the broadcast limit it shuffles its rows.
    d = docs.select("doc_id", "source", count_words().alias("size"), draw("doc_id", "text", seed).alias("key"))
    if quality is not None:
        q = quality.groupBy(F.col("doc_id").alias("q_id")).agg(F.max("weight").alias("q_weight"))
        d = d.join(by_sorting(q), F.col("doc_id") == F.col("q_id"), "left").drop("q_id")
    else:
        d = d.withColumn("q_weight", F.lit(1.0))
    weight = F.coalesce(F.col("q_weight"), F.lit(1.0))
    d = d.withColumn("key", F.col("key") / weight).drop("q_weight")
    bucket = F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int")  # rises with the key
    d = materialize(d.withColumn("bucket", bucket), "mix-sizes")

    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    per_source = sums.groupBy("source").agg(F.sum("sum").alias("source_size"))
    plan = targets(per_source, weights, share, most)
    plan = plan.withColumn("epochs", F.floor(F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # Where each source's budget ends: the bucket that holds the prefix sum `rest`.
    ends = materialize(_ends(sums, plan.withColumn("start", F.lit(0).cast("long"))), "mix-plan")
    d = d.join(ends.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    in_end = F.col("bucket") == F.col("end.bucket")
    zone = d.filter(in_end)
    span = zone.groupBy(F.col("source").alias("s_source")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    zone = zone.join(span, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    within = F.floor((F.col("key") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * buckets)
    zone = zone.withColumn("bucket", F.coalesce(F.least(within, F.lit(buckets - 1)), F.lit(0)).cast("int")).drop("lo", "hi")
    fine = ends.select("source", "source_size", "target", "epochs", "rest", F.col("end.before").alias("start"))
    fine = materialize(_ends(zone.groupBy("source", "bucket").agg(F.sum("size").alias("sum")), fine), "mix-fine")
    fine = fine.select(F.col("source").alias("p_source"), F.col("end").alias("fine"))
    zone = zone.join(fine, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    inside = W.partitionBy("source").orderBy("key", "doc_id", "size")
    in_fine = F.col("bucket") == F.col("fine.bucket")
    last = zone.filter(in_fine).withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    # The document the budget ends in gives the words that are left.
    left = F.floor(F.col("rest") - F.col("fine.before") - F.col("upto") + F.col("size"))
    last = last.withColumn("part", F.greatest(F.least(left, F.col("size")), F.lit(0)))
    beside = zone.filter(~in_fine).withColumn("part", F.when(F.col("bucket") < F.col("fine.bucket"), F.col("size")).otherwise(0))
    far = d.filter(~in_end).withColumn("part", F.when(F.col("bucket") < F.col("end.bucket"), F.col("size")).otherwise(0))
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs", F.col("part").cast("long").alias("part")]
    out = far.select(*columns).unionByName(beside.select(*columns)).unionByName(last.select(*columns))
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "part", "taken"
    )


def label_weights(labels: DataFrame, low: float = 0.25) -> DataFrame:
    """Quality weights from labels: 1 for good documents, low for bad ones."""
    w = F.when(F.col("quality") == 0, low).otherwise(1.0)
    return labels.filter("doc_id is not null").select("doc_id", w.alias("weight"))
