"""Extracted concepts against ground truth: candidates, scores, labels, metrics."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.frames import written
from loomspark.functions.text import normalize, strip

DEFINITION, NAME, PAGE, THRESHOLD = 0.60, 0.25, 0.15, 0.6


#: Pairs of texts whose ratio a Python worker remembers.
REMEMBERED = 1 << 16


@lru_cache(REMEMBERED)
def _ratio(x: str, y: str) -> float:
    """Larger of both directions' matching-block ratios."""
    return 1.0 if x == y else max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio())


@F.pandas_udf(T.DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two texts, null where one is null."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


#: Letters that the profile of a text counts one by one; all others are counted together.
COUNTED = " abcdefghijklmnopqrstuvwxyz"


def profile(text: str) -> Column:
    """How often each letter of COUNTED, and any other, occurs in a text."""
    each = [F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit(""))) for c in COUNTED]
    return F.array(*each, F.length(F.translate(text, COUNTED, "")))


def most_similar(a: str, b: str) -> Column:
    """No ratio of two texts exceeds this: both contain at most so many equal characters. Columns
    a, b and their profiles a_p, b_p."""
    shared = F.aggregate(F.zip_with(f"{a}_p", f"{b}_p", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return F.coalesce(2.0 * shared / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(1.0))


TRUTH_TEXTS = {"n1": "gt_name", "d1": "gt_definition"}
CONCEPT_TEXTS = {"n2": "name", "d2": "definition"}


def prepared(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds the normalised texts, d3 (the part of d2 before its first full stop, if any) and the
    profiles of all, once a row of truth or concepts and not once a pair."""
    rows = rows.withColumns({k: normalize(F.coalesce(F.col(c), F.lit(""))) for k, c in texts.items()})
    if "d2" in texts:
        rows = rows.withColumn("d3", F.when(F.col("d2").contains("."), F.substring_index("d2", ".", 1)))
    return rows.withColumns({f"{k}_p": profile(k) for k in (*texts, *(["d3"] if "d2" in texts else []))})


def candidates(truth: DataFrame, concepts: DataFrame) -> DataFrame:
    """truth: filename, gt_seq, page_number, ...; concepts: filename, concept_seq, page_number,
    ... Pairs on the same or a neighbouring page, by an equi-join on three keys a truth row, with
    the prepared texts of both."""
    t = truth.select("filename", "gt_seq", F.col("page_number").alias("gt_page"), F.col("name").alias("gt_name"), F.col("definition").alias("gt_definition"))
    t = prepared(t, TRUTH_TEXTS).withColumn("page_number", F.explode(F.array(*[F.col("gt_page") + d for d in (-1, 0, 1)])))
    c = concepts.select("filename", "page_number", "concept_seq", "name", "definition")
    return t.join(prepared(c, CONCEPT_TEXTS), ["filename", "page_number"])


def within_reach(pairs: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Pairs that may reach the threshold by their lengths, and then by their characters."""
    same = (F.col("page_number") == F.col("gt_page")).cast("double")
    holds = F.col("n1").contains(F.col("n2")) | F.col("n2").contains(F.col("n1"))
    by_length = lambda a, b: F.coalesce(2.0 * F.least(F.length(a), F.length(b)) / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(1.0))
    for most in (by_length, most_similar):
        definition = most("d1", "d2") if strict else F.greatest(most("d1", "d2"), F.when(F.col("d3").isNotNull(), most("d1", "d3")))
        name = F.when(holds, 1.0).otherwise(most("n1", "n2"))
        pairs = pairs.filter(DEFINITION * definition + NAME * name + PAGE * same >= threshold - 1e-9)
    return pairs


def score(pairs: DataFrame, strict: bool = False, threshold: float | None = None) -> DataFrame:
    """Adds name_score, definition_score and score to candidates. A name that contains the other
    scores 1 and is not compared; the definition's part before its first full stop counts too
    unless strict. With a threshold, pairs that cannot reach it are left out before any text is
    compared. Every worker remembers the pairs of texts it has compared."""
    p = pairs if threshold is None else within_reach(pairs, threshold, strict)
    holds = F.col("n1").contains(F.col("n2")) | F.col("n2").contains(F.col("n1"))
    p = p.withColumn("name_score", F.coalesce(sequence_similarity("n1", F.when(~holds, F.col("n2"))), F.lit(1.0)))
    part = F.lit(None).cast("string") if strict else F.col("d3")
    p = p.withColumn("definition_score", F.greatest(sequence_similarity("d1", "d2"), sequence_similarity("d1", part)))
    same = (F.col("page_number") == F.col("gt_page")).cast("double")
    total = DEFINITION * F.col("definition_score") + NAME * F.col("name_score") + PAGE * same
    return p.withColumn("score", total).drop("n1", "n2", "d1", "d2", "d3", "n1_p", "n2_p", "d1_p", "d2_p", "d3_p")


def best_matches(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best pair a truth row, the first by page and order on ties, if good enough."""
    w = W.partitionBy("filename", "gt_seq").orderBy(F.desc("score"), "page_number", "concept_seq")
    best = scored.filter("score > 0").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return best.filter(F.col("score") >= threshold)


def label(truth: DataFrame, concepts: DataFrame, best: DataFrame) -> DataFrame:
    """filename, kind, gt_seq, concept_seq, score: the first truth row that picks a concept is
    TP, later ones and unmatched ones FN, never picked concepts FP."""
    w = W.partitionBy("filename", "concept_seq").orderBy("gt_seq")
    picked = written(best.select("filename", "gt_seq", "concept_seq", "score").withColumn("r", F.row_number().over(w)), "picked")
    hits = truth.select("filename", "gt_seq").join(picked, ["filename", "gt_seq"], "left")
    kind = F.when(F.col("r") == 1, "TP").otherwise("FN")
    a = hits.select("filename", kind.alias("kind"), "gt_seq", "concept_seq", "score")
    free = concepts.select("filename", "concept_seq").join(picked.select("filename", "concept_seq").distinct(), ["filename", "concept_seq"], "left_anti")
    b = free.select("filename", F.lit("FP").alias("kind"), F.lit(None).cast("long").alias("gt_seq"), "concept_seq", F.lit(None).cast("double").alias("score"))
    return a.unionByName(b)


def metrics(labels: DataFrame) -> DataFrame:
    """Counts, totals of extracted and truth rows, precision, recall and F1 per document and
    over all (null filename)."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k.lower())
    c = labels.groupBy("filename").agg(n("TP"), n("FP"), n("FN"))
    c = c.unionByName(c.agg(F.lit(None).cast("string").alias("filename"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")]))
    # a picked concept is TP for one truth row
    c = c.withColumn("total_extracted", F.col("tp") + F.col("fp")).withColumn("total_ground_truth", F.col("tp") + F.col("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1: Column = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.withColumn("f1_score", f1)


def samples(labels: DataFrame, most: int = 50) -> DataFrame:
    """The first rows of every kind and document, and how many there are beyond."""
    g = W.partitionBy("filename", "kind")
    out = labels.withColumn("r", F.row_number().over(g.orderBy("gt_seq", "concept_seq"))).withColumn("n", F.count("*").over(g))
    return out.filter(F.col("r") <= most).withColumn("more", F.greatest(F.col("n") - most, F.lit(0))).drop("n")


def clean_highlights(rows: DataFrame) -> DataFrame:
    """filename, ord, page, text, type: blanks collapsed, empty ones dropped, first a text."""
    t = rows.withColumn("text", F.regexp_replace(strip("text"), r"(?U)\s+", " ")).filter("text <> ''")
    return t.withColumn("r", F.row_number().over(W.partitionBy("filename", "text").orderBy("ord"))).filter("r = 1").drop("r")
