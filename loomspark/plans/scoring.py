"""Queries of the evaluation of extracted concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.frames import written
from loomspark.functions.text import normalize
from loomspark.operators import chunking, concepts, evaluation
from loomspark.plans.documents import elements
from loomspark.plans.registry import query, table


@query(r"""
SELECT doc_id, trim(regexp_replace(trim(regexp_replace(lower(text), '[\s\x0b\x{85}\x{a0}]+', ' ', 'g'), ' '), '\.[0-9]+\s*', '. ', 'g'), '.,;:') AS text FROM documents""")
def f1_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize("text").alias("text"))


def _pairs(spark, sf_dir):
    """Orders as truth, lines as concepts: page from the dates, the score an input column."""
    o = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey as string) as filename", "o_orderkey as gt_seq", "cast(o_orderkey % 20 as int) as page_number", "'a' as name", "'b' as definition")
    li = table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey as string) as filename", "l_orderkey * 10 + l_linenumber as concept_seq", "cast(l_partkey % 20 as int) as page_number", "'a' as name", "'b' as definition")
    scored = evaluation.candidates(o, li).withColumn("score", F.pmod(F.col("gt_seq") * 7 + F.col("concept_seq") * 13, F.lit(100)) / 100)
    return o, li, scored


_W3 = """
WITH o AS (SELECT o_custkey::VARCHAR AS filename, o_orderkey AS gt_seq, (o_orderkey % 20)::INT AS p FROM orders),
l AS (SELECT l_suppkey::VARCHAR AS filename, l_orderkey * 10 + l_linenumber AS concept_seq, (l_partkey % 20)::INT AS p FROM lineitem),
c AS (SELECT o.filename, gt_seq, concept_seq, l.p, ((gt_seq * 7 + concept_seq * 13) % 100) / 100.0::DOUBLE AS score
      FROM o JOIN l ON o.filename = l.filename AND l.p BETWEEN o.p - 1 AND o.p + 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, gt_seq ORDER BY score DESC, p, concept_seq) AS r FROM c WHERE score > 0) WHERE r = 1 AND score >= 0.6),
k AS (SELECT *, row_number() OVER (PARTITION BY filename, concept_seq ORDER BY gt_seq) AS n FROM b),
lab AS (SELECT o.filename, CASE WHEN k.n = 1 THEN 'TP' ELSE 'FN' END AS kind, o.gt_seq, k.concept_seq, k.score FROM o LEFT JOIN k ON o.filename = k.filename AND o.gt_seq = k.gt_seq
      UNION ALL SELECT l.filename, 'FP', NULL, l.concept_seq, NULL FROM l ANTI JOIN k ON l.filename = k.filename AND l.concept_seq = k.concept_seq)
"""


@query(_W3 + "SELECT filename, gt_seq, concept_seq, score FROM b")
def f7_best_matches(spark, sf_dir):
    return evaluation.best_matches(_pairs(spark, sf_dir)[2]).select("filename", "gt_seq", "concept_seq", "score")


@query(_W3 + "SELECT * FROM lab")
def f8_labels(spark, sf_dir):
    o, li, scored = _pairs(spark, sf_dir)
    return evaluation.label(o, li, evaluation.best_matches(scored))


@query(_W3 + """, m AS (SELECT filename, count(*) FILTER (kind = 'TP') AS tp, count(*) FILTER (kind = 'FP') AS fp, count(*) FILTER (kind = 'FN') AS fn FROM lab GROUP BY ROLLUP (filename)),
q AS (SELECT *, tp + fp AS total_extracted, tp + fn AS total_ground_truth, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM m)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM q""")
def f10_metrics(spark, sf_dir):
    o, li, scored = _pairs(spark, sf_dir)
    return evaluation.metrics(evaluation.label(o, li, evaluation.best_matches(scored)))


@query(_W3 + """, s AS (SELECT *, row_number() OVER (PARTITION BY filename, kind ORDER BY gt_seq NULLS FIRST, concept_seq NULLS FIRST) AS r, count(*) OVER (PARTITION BY filename, kind) AS n FROM lab)
SELECT filename, kind, gt_seq, concept_seq, r::INT AS r, greatest(n - 50, 0) AS more FROM s WHERE r <= 50""")
def f11_samples(spark, sf_dir):
    o, li, scored = _pairs(spark, sf_dir)
    return evaluation.samples(evaluation.label(o, li, evaluation.best_matches(scored))).drop("score")


def scored_pairs(spark, sf_dir, strict: bool = False, threshold: float | None = None):
    """Explicit definitions of documents as concepts; as truth the same ones, some on the next
    page, with a longer name, without their first letters, or in other words."""
    found = concepts.rule_concepts(written(chunking.chunk(elements(spark, sf_dir)), "chunks")).withColumn("concept_seq", F.col("chunk_seq") * 1000 + F.col("item_seq"))
    found = written(found.select("filename", "concept_seq", "page_number", "name", "definition"), "found")
    kind = F.col("concept_seq") % 5
    truth = found.select(
        "filename", F.col("concept_seq").alias("gt_seq"), (F.col("page_number") + F.when(kind == 1, 1).otherwise(0)).alias("page_number"),
        F.when(kind == 2, F.concat(F.lit("the "), "name")).when(kind == 4, F.reverse("name")).otherwise(F.col("name")).alias("name"),
        F.when(kind == 3, F.col("definition").substr(F.lit(12), F.length("definition"))).when(kind == 4, F.reverse("definition")).otherwise(F.concat("definition", F.lit(". More"))).alias("definition"),
    )
    return truth, found, evaluation.score(evaluation.candidates(truth, found), strict, threshold)


@query()
def f6_scores(spark, sf_dir):
    """Real scores of all candidate pairs; the ratio is no SQL function, so tests check it."""
    return scored_pairs(spark, sf_dir)[2]


@query()
def w3_extraction_quality(spark, sf_dir):
    """The whole evaluation, with pairs pruned that cannot reach the threshold."""
    truth, found, scored = scored_pairs(spark, sf_dir, threshold=evaluation.THRESHOLD)
    return evaluation.metrics(evaluation.label(truth, found, evaluation.best_matches(scored)))
