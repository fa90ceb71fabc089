"""Operator 5, substring dedup by hashing lines, paragraphs or sentences.

Every text is cut into units, a unit is normalised (case, blanks) and hashed to 128 bits, equal
digests meet globally, and the earliest ranked occurrence stays. Rank is (doc_id, nulls last;
hash of the text; unit number). The later ones are removed where they form a passage: a run of
consecutive repeated units of at least MIN_PASSAGE characters. So a common short line of clean
documents stays, and a passage of short sentences goes, wherever its lines begin. Sizes count
characters, as not every script puts blanks between words.

Every unit with a character that is no blank is hashed, and one that is not repeated ends a run, so
nothing goes that does not occur elsewhere. With unit "line" or "paragraph" and min_passage 1 every
later occurrence of a line or paragraph goes.

Counting and the earliest rank combine on the map side, and the join back salts frequent digests,
so a unit in a third of all documents does not meet in one task.

Defined results: null text stays null, empty text stays empty; newlines outside a passage stay; offsets are code
points of the original text; of rows equal in doc_id and text one counts as the earliest, the
others are later occurrences; an empty table gives no rows; the caller's columns all stay.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import broadcast_if_small, carried, join_counted, materialize, maybe_in

MIN_UNIT, MIN_PASSAGE = 1, 120
#: Where a text is cut into tokens; every character lies in exactly one.
CUTS = {
    "sentence": "(?<=\n)|(?=\n)|(?<=[.!?。！？])(?![.!?。！？\n])",
    "line": "(?<=\n)|(?=\n)",
    "paragraph": "(?<=\n\n)|(?=\n\n)",
}
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_KEY = ["doc_id", "h"]


def unit_digests(docs: DataFrame, unit: str = "sentence", min_unit: int = MIN_UNIT) -> DataFrame:
    """docs: doc_id, text, h. doc_id, h, j (number among the long enough units), k (number of its
    token), n (characters), d1, d2 (digest) of every unit long enough."""
    norm = lambda s: F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))
    tokens = F.split("text", CUTS[unit])
    units = F.filter(F.transform(tokens, lambda s, k: F.struct(k.alias("k"), norm(s).alias("s"))), lambda u: F.length(u["s"]) >= min_unit)
    each = docs.select("doc_id", "h", F.posexplode(units).alias("j", "u"))
    digest = [F.xxhash64("u.s").alias("d1"), F.xxhash64(F.lit(1), F.col("u.s")).alias("d2")]
    return each.select("doc_id", "h", "j", F.col("u.k").alias("k"), F.length("u.s").alias("n"), *digest)


def repeated_passages(docs: DataFrame, unit: str = "sentence", min_unit: int = MIN_UNIT, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """docs: doc_id, text, h, distinct. doc_id, h, runs (array of first and last token) and
    n_removed (units) of the documents that lose passages."""
    units = unit_digests(docs, unit, min_unit)
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h", "j")
    first = units.groupBy("d1", "d2").agg(F.count("*").alias("count"), F.min(rank).alias("first")).filter("count > 1")
    first = materialize(first, "units-first")
    again = maybe_in(units, "d1", first.select("d1")).filter("maybe").drop("maybe")
    again = join_counted(again, first, ["d1", "d2"], "count", F.struct("doc_id", "h", "j"))
    later = again.filter(~rank.eqNullSafe(F.col("first")))
    by_doc = W.partitionBy(*_KEY)
    later = later.withColumn("run", F.col("j") - F.row_number().over(by_doc.orderBy("j")))
    runs = later.groupBy(*_KEY, "run").agg(F.sum("n").alias("size"), F.count("*").alias("units"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    runs = runs.filter(F.col("size") >= min_passage)
    return runs.groupBy(*_KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"), F.sum("units").alias("n_removed"))


def _cut(unit: str):
    pattern = re.compile(CUTS[unit])

    def run(batches):
        for batch in batches:
            text, removed = [], []
            for t, r in zip(batch.column("text"), batch.column("runs"), strict=True):
                whole, parts, spans, at = t.as_py(), [], [], 0
                ends = [0, *(m.end() for m in pattern.finditer(whole) if 0 < m.end() < len(whole)), len(whole)]
                for lo, hi in sorted((x["lo"], x["hi"]) for x in r.as_py()):
                    parts.append(whole[at : ends[lo]])
                    at = ends[hi + 1]
                    spans.append({"start": ends[lo], "end": at})
                text.append("".join(parts) + whole[at:])
                removed.append(spans)
            cols = [batch.column("row"), pa.array(text, pa.string()), batch.column("n_removed"), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "text", "n_removed", "removed"])

    return run


def _first_of_equal(docs: DataFrame, min_unit: int) -> tuple[DataFrame, DataFrame | None]:
    """carried docs, without the second and later ones of rows equal in doc_id and text; and
    these, if there are any (written: which row is the first must not change)."""
    many = materialize(docs.groupBy(*_KEY).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h")), "units-equal")
    if many.isEmpty():
        return docs, None
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h"))
    equal = docs.join(broadcast_if_small(many), same, "left_semi").withColumn("place", F.monotonically_increasing_id())
    equal = materialize(equal, "units-equal-rows")
    one = equal.groupBy(*_KEY).agg(F.min("place").alias("place")).select("place")
    single = docs.join(broadcast_if_small(many), same, "left_anti").unionByName(equal.join(one, "place", "left_semi").drop("place"))
    return single, equal.join(one, "place", "left_anti").drop("place")


def dedup_units(docs: DataFrame, unit: str = "sentence", min_unit: int = MIN_UNIT, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """row (the caller's columns), text without repeated passages, n_removed (units) and removed
    (array of start, end in the original text, null where nothing goes)."""
    single, others = _first_of_equal(carried(docs), min_unit)
    gone = repeated_passages(single.select("doc_id", "h", "text"), unit, min_unit, min_passage)
    gone = materialize(gone.withColumnRenamed("doc_id", "g_id").withColumnRenamed("h", "g_h"), "units-gone")
    maybe = maybe_in(single, "h", gone.select("g_h"))
    hit = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h"))
    known = maybe.filter("maybe").join(gone, hit, "left")
    if others is not None:
        # every passage of an equal row has its earlier occurrence: the row loses all of them
        units = unit_digests(others.select("doc_id", "h", "text").distinct(), unit, min_unit)
        whole = units.groupBy(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h")).agg(
            F.array(F.struct(F.min("k").alias("lo"), F.max("k").alias("hi"))).alias("runs"), F.count("*").alias("n_removed"), F.sum("n").alias("size")
        )
        whole = whole.filter(F.col("size") >= min_passage).drop("size")
        known = known.unionByName(others.withColumn("maybe", F.lit(True)).join(whole, hit, "left"))
    schema = T.StructType([known.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", SPANS)])
    cut = known.filter("runs is not null").select("row", "text", "runs", "n_removed").mapInArrow(_cut(unit), schema)
    rest = maybe.filter("not maybe").select("row", "text").unionByName(known.filter("runs is null").select("row", "text"))
    return cut.unionByName(rest.withColumn("n_removed", F.lit(0).cast("long")).withColumn("removed", F.lit(None).cast(SPANS)))
