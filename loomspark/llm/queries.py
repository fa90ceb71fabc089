"""One query an operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bit_sliced, conversation_repair, decontaminate, language_id, license_scan, line_crf, line_dedup, masked_lm, mixing, ngram_quality, simhash_dedup, spelling, suffix_dedup
from loomspark.llm.common import table


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "mean_log_prob", "log_likelihood", "pseudo_perplexity", "n_tokens")


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "labels").filter(_remainder(5) != 0)
    out = line_crf.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), learn)
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "good_share", "n_lines")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.label_weights(table(spark, sf_dir, "labels"))
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), weights)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "bits", "low", "high")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="sentence", min_unit=1, min_passage=120)
    spans = F.transform(F.col("removed"), lambda r: F.concat_ws(":", r["start"], r["end"]))
    return out.select("row.doc_id", "text", "n_removed", F.coalesce(F.array_join(spans, ","), F.lit("")).alias("removed"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("h")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, docs.filter(_remainder(3) != 1))
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(rows), rows)


def op12_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bit_sliced.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.damaged_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(spelling.vocabulary(runs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_masked_lm,
        op2_line_crf,
        op3_mixing,
        op4_ngram_rules,
        op5_line_dedup,
        op6_simhash,
        op7_decontamination,
        op8_language_id,
        op9_license_scan,
        op10_suffix_dedup,
        op11_conversation_repair,
        op12_bit_sliced_top_k,
        op13_spelling_variants,
    )
}

_MIX = """
WITH d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null' || md5(coalesce(d.text, ''))) || ':mix-1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
           / coalesce(q.w, 1.0) AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 0 THEN 0.25 ELSE 1.0 END) AS w FROM labels GROUP BY 1) q
    ON d.doc_id = q.doc_id),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS stop, 2.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(stop) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
o AS (SELECT level, ratio, rank FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (
  SELECT l.source, l.source_size,
         CASE WHEN (l.ratio, l.rank) >= (o.ratio, o.rank) THEN o.level * l.weight ELSE l.stop END AS target
  FROM l LEFT JOIN o ON true),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(rest - before))))::BIGINT AS taken FROM c
"""


def _license_sql() -> str:
    rows = ", ".join(f"('{label}', {license_scan.template_words(text)!r})" for label, text in license_scan.TEMPLATES)
    phrases = license_scan.PHRASES
    tests = " ".join(f"WHEN w[i : i + {len(p.split()) - 1}] = {p.split()!r} THEN '{label}'" for p, label in phrases)
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({lower}, '{sep}'), lambda x: x <> '') AS w,
                  string_split({lower}, chr(10)) AS lines FROM documents),
spots AS (SELECT doc_id, i - 1 AS i, CASE {tests} END AS label
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels FROM spots WHERE label IS NOT NULL GROUP BY 1),
b AS (SELECT doc_id, list_distinct(string_split_regex(line, '{sep}')) AS words FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(words, t)) / len(t) AS c FROM b, (VALUES {rows}) v(label, t)
      WHERE len(list_intersect(words, t)) >= ceil({license_scan.CONTAINMENT} * len(t) - 1e-9)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM m GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.first::BIGINT AS first_word, base.last::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(more.c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


_UNITS = r"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?。！？\n]+[.!?。！？]*|[.!?。！？]+|\n') AS tokens FROM documents),
u AS (SELECT doc_id, unnest(tokens) AS s, unnest(range(len(tokens))) AS k FROM t),
n AS (SELECT *, trim(regexp_replace(lower(s), '[\s\x0b\x{85}\x{a0}]+', ' ', 'g')) AS norm,
             sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM u),
j AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j FROM n WHERE length(norm) >= {unit}),
f AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, j) > 1 AS again FROM j),
r AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS run FROM f WHERE again),
p AS (SELECT doc_id, min(k) AS lo, max(k) AS hi, count(*) AS units, min(stop - length(s)) AS start, max(stop) AS stop
      FROM r GROUP BY doc_id, run HAVING sum(length(norm)) >= {passage}),
g AS (SELECT doc_id, sum(units)::BIGINT AS n_removed, string_agg(start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY lo) AS removed FROM p GROUP BY doc_id),
kept AS (SELECT n.doc_id, string_agg(s, '' ORDER BY n.k) AS text
      FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = n.doc_id AND n.k BETWEEN p.lo AND p.hi) GROUP BY n.doc_id)
SELECT t.doc_id, CASE WHEN g.n_removed > 0 THEN coalesce(kept.text, '') ELSE t.text END AS text, coalesce(g.n_removed, 0) AS n_removed, coalesce(g.removed, '') AS removed
FROM t LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
""".replace("{unit}", "1").replace("{passage}", "120")

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: crc32 is linear: of a message of 4 bytes or more it is the complement of the xor of one table
#: entry a byte, where tables[k] is the byte table moved on by k bytes and the first 4 bytes are complemented.
_SPELLING = """
WITH RECURSIVE byte AS (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS b)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
g AS (SELECT d, run, count(*) AS k, hex(encode(d || ':' || run)) AS hex FROM runs WHERE length(run) >= 6 GROUP BY d, run),
tables(k, b, v) AS (
  SELECT 0, b, v FROM byte
  UNION ALL
  SELECT t.k + 1, t.b, xor(t.v // 256, byte.v) FROM tables t JOIN byte ON byte.b = t.v % 256 WHERE t.k < (SELECT max(length(hex)) // 2 FROM g)),
bytes AS (SELECT d, run, i, length(hex) // 2 AS n, ('0x' || substr(hex, 2 * i + 1, 2))::BIGINT AS b FROM (SELECT *, unnest(range(length(hex) // 2)) AS i FROM g)),
crc AS (SELECT d, run, xor(bit_xor(t.v), 4294967295) AS h
        FROM bytes JOIN tables t ON t.k = n - 1 - i AND t.b = CASE WHEN i < 4 THEN 255 - bytes.b ELSE bytes.b END GROUP BY d, run),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
      FROM g JOIN crc USING (d, run) GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT less.word AS a, w.word AS b FROM less JOIN w ON w.word = rest
  UNION SELECT w.word, less.word FROM less JOIN w ON w.word = rest
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, w.n, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS r FROM near JOIN w ON w.word = b),
f AS (SELECT w.word, w.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN best.n >= 5 * w.n THEN best.b END AS form, CASE WHEN best.n >= 5 * w.n THEN best.n END AS form_n
      FROM w LEFT JOIN best ON best.a = w.word AND best.r = 1),
way(word, root, step) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN last USING (word)
"""

ORACLES: dict[str, str] = {"op3_mixing": _MIX, "op5_line_dedup": _UNITS, "op9_license_scan": _license_sql(), "op12_bit_sliced_top_k": _TOP_K, "op13_spelling_variants": _SPELLING}
