"""Queries of sources and chunking, over elements derived from documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.frames import shared_path
from loomspark.functions.text import is_list_item
from loomspark.operators import chunking, evaluation, store
from loomspark.plans.registry import query, table
from loomspark.sources import elements as src

# What triggers the rules, as SQL of both engines (DIV is the integer division): a place in the
# document, and the text that stands there instead of the document's own.
_MARKS = """
CASE WHEN el_seq = 10 AND fid % 3 = 0 THEN '  Preface ' WHEN el_seq = 3 AND fid % 4 = 0 THEN 'Table of Contents'
     WHEN el_seq = 9 AND fid % 5 = 0 THEN 'see Chapter 1 below' WHEN el_seq = 17 AND fid % 2 = 0 THEN 'Chapter 1 Begin'
     WHEN el_seq = 25 AND fid % 3 = 1 THEN 'CHAPTER 10' WHEN el_seq = 300 THEN 'Chapter 1 again'
     WHEN el_seq % 37 = 5 THEN ' UNCLASSIFIED ' WHEN el_seq % 41 = 7 THEN '  Edition A' WHEN el_seq % 43 = 9 THEN ' xii '
     WHEN el_seq % 47 = 13 THEN '  1. an item of the list.'
     WHEN el_seq % 53 = 21 THEN 'Movement. Movement is moving people and things.' WHEN el_seq % 59 = 31 THEN 'Cooperation. Cooperation between authorities is essential.'
     WHEN el_seq % 61 = 17 THEN 'Supply line means whatever carries supplies!'
     WHEN el_seq % 33 = 11 THEN concat('Lexicon of part ', cast(el_seq DIV 11 % 3 AS string))
     WHEN el_seq % 7 = 3 THEN concat('Running head ', cast((fid + el_seq DIV 16) % 3 AS string)) ELSE text END"""
_CATEGORY = "CASE WHEN el_seq % 11 = 0 THEN 'Title' WHEN el_seq % 7 = 3 THEN 'Header' WHEN el_seq % 5 = 2 THEN 'ListItem' ELSE 'NarrativeText' END"


def elements(spark, sf_dir) -> DataFrame:
    """Elements of documents; page, category, height and marks follow from doc_id and el_seq."""
    d = src.text_elements(table(spark, sf_dir, "documents")).selectExpr("filename", "cast(el_seq as bigint) as el_seq", "text", "cast(filename as bigint) as fid")
    return d.selectExpr(
        "filename", "el_seq", "cast(el_seq DIV 8 + 1 as int) as page_number", f"{_CATEGORY} as category", f"{_MARKS} as text", "cast((el_seq * 131 + fid) % 780 as double) as y"
    )


def _duck(expression: str) -> str:
    return expression.replace("DIV", "//").replace("AS string", "AS VARCHAR")


E_SQL = rf"""
WITH RECURSIVE e00 AS (SELECT doc_id::VARCHAR AS filename, doc_id AS fid, unnest(string_split_regex(text, '\n|, ')) AS text,
                   unnest(range(len(string_split_regex(text, '\n|, '))))::BIGINT AS el_seq FROM documents),
e0 AS (SELECT filename, fid, el_seq, {_duck(_MARKS)} AS text FROM e00),
e AS (SELECT filename, el_seq, (el_seq // 8 + 1)::INT AS page_number, {_CATEGORY} AS category,
             text, ((el_seq * 131 + fid) % 780)::DOUBLE AS y, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM e0)
"""


@query(E_SQL + "SELECT filename, el_seq, page_number, category, text FROM e")
def a1_text_elements(spark, sf_dir):
    return elements(spark, sf_dir).drop("y")


@query(r"""
WITH p AS (SELECT url AS filename, string_split(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?is)<(title|h[1-6]|li|p|t[dh]|header|nav|footer)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM pages),
u AS (SELECT filename, unnest(parts) AS part, unnest(range(len(parts)))::INT AS el_seq FROM p),
t AS (SELECT filename, el_seq, lower(split_part(part, chr(2), 1)) AS tag, regexp_replace(string_split(part, chr(2))[-1], '(?s)<[^>]*>', ' ', 'g') AS body FROM u WHERE contains(part, chr(2))),
d AS (SELECT filename, el_seq, CASE WHEN regexp_matches(tag, '^(title|h[1-6])$') THEN 'Title' WHEN tag = 'li' THEN 'ListItem' WHEN tag IN ('p', 'td', 'th') THEN 'NarrativeText'
             WHEN tag IN ('header', 'nav') THEN 'Header' ELSE 'Footer' END AS category,
             trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t)
SELECT * FROM d WHERE text <> ''""")
def a1_html_elements(spark, sf_dir):
    return src.html_elements(table(spark, sf_dir, "pages"))


#: Rows of one file of the round trips below: files grow in number, not in size.
_PER_FILE = 500


def _written(spark, rows: DataFrame, body, name: str) -> str:
    """JSON files, one value a file: body aggregates the rows of a file to one text."""
    path = shared_path(spark, name)
    rows.groupBy("file").agg(body.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


@query("SELECT doc_id::VARCHAR AS id, text, (doc_id % 9)::INT AS page_number, source AS filename, lang AS tag FROM documents WHERE text IS NOT NULL")
def a2_read_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    rows = d.selectExpr(f"doc_id div {_PER_FILE} as file", "struct(cast(doc_id as string) as id, text, cast(doc_id % 9 as int) as page_number, source as filename, array(lang) as page_tags) as c")
    path = _written(spark, rows, F.to_json(F.collect_list("c")), "chunks")
    return src.read_chunks(spark, path + "/*").select("id", "text", "page_number", "filename", F.col("page_tags")[0].alias("tag"))


@query(f"SELECT doc_id // {_PER_FILE} AS file, row_number() OVER (PARTITION BY doc_id // {_PER_FILE} ORDER BY doc_id) - 1 AS chunk_seq, text FROM documents WHERE doc_id // {_PER_FILE} % 2 = 0")
def a2_read_chunk_contents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr(f"doc_id div {_PER_FILE} as file", "doc_id", "text as content")
    items = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "content"))), lambda x: F.struct(x["content"].alias("content")))
    whole = F.when(F.first("file") % 2 == 0, F.to_json(F.struct(items.alias("chunks")))).otherwise("{}")
    out = src.read_chunk_contents(spark, _written(spark, d, whole, "contents") + "/*")
    return out.select(F.regexp_extract("filename", "file=([0-9]+)", 1).cast("long").alias("file"), F.col("chunk_seq").cast("long").alias("chunk_seq"), "text")


@query("SELECT item_id::VARCHAR AS id, 'c' || item_id AS name, text AS definition, 'k' AS chunk_id, item_id::INT AS page_number, 'bench' AS filename FROM benchmark")
def a3_read_concepts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    rows = b.selectExpr(f"item_id div {_PER_FILE} as file", "struct(cast(item_id as string) as id, concat('c', item_id) as name, text as definition, 'k' as chunk_id, cast(item_id as int) as page_number, 'bench' as filename) as c")
    return src.read_concepts(spark, _written(spark, rows, F.to_json(F.collect_list("c")), "concepts") + "/*")


@query("SELECT conv_id AS file, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS gt_seq, role AS name, text AS definition, turn::INT AS page_number FROM conversations")
def a4_read_truth(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "file")
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("name"), x["text"].alias("definition"), x["turn"].alias("page_number")))
    out = src.read_truth(spark, _written(spark, c, F.to_json(F.struct(items.alias("concepts"))), "truth") + "/*")
    return out.select(F.regexp_extract("filename", "file=([0-9]+)", 1).cast("long").alias("file"), "gt_seq", "name", "definition", "page_number")


@query("SELECT doc_id, text, lang FROM documents")
def a6_write_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = shared_path(spark, "rows")
    src.write_rows(d, path)
    return spark.read.schema(d.schema).json(path)


@query(E_SQL + r""", h AS (SELECT filename, min(el_seq) AS ord, min_by(page_number, el_seq) AS page, regexp_replace(s, '\s+', ' ', 'g') AS text FROM e WHERE s <> '' GROUP BY filename, regexp_replace(s, '\s+', ' ', 'g'))
SELECT filename AS source, count(*) AS total_concepts, string_agg(page || ':' || text || ':Highlight', chr(10) ORDER BY ord) AS concepts FROM h GROUP BY filename""")
def a8_truth_documents(spark, sf_dir):
    rows = elements(spark, sf_dir).select("filename", F.col("el_seq").alias("ord"), F.col("page_number").alias("page"), "text", F.lit("Highlight").alias("type"))
    out = src.truth_documents(evaluation.clean_highlights(rows))
    return out.withColumn("concepts", F.array_join(F.transform("concepts", lambda c: F.concat_ws(":", c["page"], c["text"], c["type"])), "\n"))


_B1 = r""", b1 AS (
SELECT filename, min(CASE WHEN contains(lower(s), 'chapter 1') AND page_number > greatest(coalesce(p, 0), coalesce(t, 0)) THEN page_number END) AS page
FROM (SELECT *, arg_max(page_number, el_seq) FILTER (lower(s) = 'preface') OVER (PARTITION BY filename) AS p,
             arg_max(page_number, el_seq) FILTER (lower(s) = 'table of contents') OVER (PARTITION BY filename) AS t
      FROM (SELECT *, min(CASE WHEN page_number > 25 THEN el_seq END) OVER (PARTITION BY filename) AS stop FROM e) WHERE stop IS NULL OR el_seq <= stop)
GROUP BY filename),
body AS (SELECT e.* FROM e JOIN b1 USING (filename)
         JOIN (SELECT e.filename, min(e.el_seq) AS place FROM e JOIN b1 ON e.filename = b1.filename AND e.page_number >= coalesce(b1.page, 0) GROUP BY 1) f USING (filename) WHERE el_seq >= place)
"""


@query(E_SQL + _B1 + "SELECT * FROM b1")
def b1_first_chapter(spark, sf_dir):
    return chunking.first_chapter_page(elements(spark, sf_dir))


@query(E_SQL + _B1 + "SELECT filename, el_seq FROM body")
def b2_skip(spark, sf_dir):
    return chunking.skip_to_first_chapter(elements(spark, sf_dir)).select("filename", "el_seq")


def _tags(source: str) -> str:
    """Page tags and their propagation, page by page."""
    return rf""", tg AS (
SELECT filename, page_number, list(s ORDER BY el_seq) AS tags, row_number() OVER (PARTITION BY filename ORDER BY page_number) AS rn FROM {source}
WHERE category IN ('Header', 'Title') AND length(s) > 5 AND NOT regexp_matches(lower(s), '^(unclassified|restricted|edition|intentionally blank)') GROUP BY filename, page_number),
tl AS (SELECT *, list_transform(tags, lambda t: lower(t)) AS low,
              list_filter(['lexicon', 'acronyms', 'abbreviations', 'terms', 'definitions'], lambda k: contains(lower(array_to_string(tags, chr(10))), k)) AS found FROM tg),
pr AS (SELECT filename, rn, page_number, tags, low, found, CASE WHEN len(found) > 0 THEN low ELSE [] END AS known FROM tl WHERE rn = 1
       UNION ALL
       SELECT t.filename, t.rn, t.page_number, t.tags, t.low,
              CASE WHEN list_has_any(t.low, pr.known) AND NOT list_contains(t.found, 'lexicon') THEN list_append(t.found, 'lexicon') ELSE t.found END,
              CASE WHEN len(t.found) > 0 OR list_has_any(t.low, pr.known) THEN list_distinct(list_concat(pr.known, t.low)) ELSE pr.known END
       FROM pr JOIN tl t ON t.filename = pr.filename AND t.rn = pr.rn + 1),
pl AS (SELECT filename, page_number, CASE WHEN len(found) > 0 THEN list_sort(found) ELSE tags END AS tags FROM pr),
pt AS (SELECT filename, page_number, array_to_string(tags, '|') AS tags FROM pl)
"""


@query(E_SQL + _tags("e") + "SELECT filename, page_number, array_to_string(tags, '|') AS tags FROM tg")
def b3_page_tags(spark, sf_dir):
    return chunking.page_tags(elements(spark, sf_dir)).select("filename", "page_number", store.pack_tags("tags").alias("tags"))


@query(E_SQL + _tags("e") + "SELECT filename, page_number, tags FROM pt")
def b4_propagated_tags(spark, sf_dir):
    return chunking.propagate_tags(chunking.page_tags(elements(spark, sf_dir))).withColumn("tags", store.pack_tags("tags"))


_GONE = """category = 'Header' OR (lower(s) IN ('unclassified', 'restricted', 'secret') AND (y >= 724 OR y <= 52)) OR (starts_with(lower(s), 'edition') AND y >= 724)
  OR (y >= 724 AND regexp_matches(s, '^(?:[0-9]+|p[0-9]+|[ivxlcdmIVXLCDM]+|[A-Za-z0-9]+-[A-Za-z0-9]+)$'))"""


@query(E_SQL + f"SELECT filename, el_seq FROM e WHERE NOT ({_GONE})")
def b9_drop_headers(spark, sf_dir):
    return chunking.drop_headers(elements(spark, sf_dir)).select("filename", "el_seq")


@query(E_SQL + r"SELECT filename, el_seq FROM e WHERE regexp_matches(text, '^\s*(?:\d+[.)]|[A-Za-z][.)]|i{1,3}\.)')")
def b10_list_items(spark, sf_dir):
    return elements(spark, sf_dir).filter(is_list_item(F.col("text"))).select("filename", "el_seq")


def _fold(source: str) -> str:
    """The fold, element by element, over the rows of source."""
    return rf""", n AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY el_seq) AS rn, length(s) AS n,
                    regexp_matches(s, '[.)\]]$') AND NOT regexp_matches(s, '^\s*(?:\d+[.)]|[A-Za-z][.)]|i{{1,3}}\.)') AS closes FROM {source}),
f AS (SELECT filename, rn, page_number, n, s, closes, 0::BIGINT AS k, n AS size, closes AS shut FROM n WHERE rn = 1
      UNION ALL
      SELECT n.filename, n.rn, n.page_number, n.n, n.s, n.closes,
             CASE WHEN f.shut OR f.size + n.n > 750 THEN f.k + 1 ELSE f.k END,
             CASE WHEN f.shut OR f.size + n.n > 750 THEN n.n ELSE f.size + n.n END, n.closes
      FROM f JOIN n ON n.filename = f.filename AND n.rn = f.rn + 1),
g AS (SELECT filename, k, arg_min(page_number, rn) AS page_number, string_agg(s, chr(10) ORDER BY rn) FILTER (s <> '') AS text,
             arg_max(closes, rn) AS closed, k = max(k) OVER (PARTITION BY filename) AS last FROM f GROUP BY filename, k),
c AS (SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY k) - 1 AS chunk_seq, page_number, text FROM g
      WHERE text IS NOT NULL AND (closed OR NOT last))
"""


@query(E_SQL + _fold("e") + "SELECT filename, chunk_seq, page_number, text FROM c")
def b11_chunk_fold(spark, sf_dir):
    return chunking.chunk(elements(spark, sf_dir))


@query(E_SQL + _fold("e") + _tags("e") + "SELECT c.filename, c.chunk_seq, c.page_number, coalesce(pt.tags, '') AS page_tags FROM c LEFT JOIN pt USING (filename, page_number)")
def b12_attached_tags(spark, sf_dir):
    e = elements(spark, sf_dir)
    out = chunking.attach_tags(chunking.chunk(e), chunking.propagate_tags(chunking.page_tags(e)))
    return out.select("filename", "chunk_seq", "page_number", store.pack_tags("page_tags").alias("page_tags"))


B13_SQL = E_SQL + _B1 + _tags("body") + f", hd AS (SELECT * FROM body WHERE NOT ({_GONE}))" + _fold("hd") + """, ch AS (
SELECT c.filename, c.chunk_seq, c.page_number, c.text, coalesce(pt.tags, '') AS page_tags,
       sha256(c.filename || chr(1) || c.chunk_seq || chr(1) || c.text) AS id FROM c LEFT JOIN pt USING (filename, page_number))
"""


@query(B13_SQL + "SELECT * FROM ch")
def b13_chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(elements(spark, sf_dir)).withColumn("page_tags", store.pack_tags("page_tags"))


@query(E_SQL + _fold("e") + "SELECT filename, count(*) AS n_chunks, count(DISTINCT filename) AS n_files FROM c GROUP BY ROLLUP (filename)")
def b14_chunk_counts(spark, sf_dir):
    return chunking.chunk_counts(chunking.chunk(elements(spark, sf_dir)))


@query(E_SQL + r""", h AS (SELECT filename, el_seq, regexp_replace(s, '\s+', ' ', 'g') AS text FROM e WHERE s <> '')
SELECT filename, min(el_seq) AS ord, text FROM h GROUP BY filename, text""")
def f12_highlights(spark, sf_dir):
    rows = elements(spark, sf_dir).withColumnRenamed("el_seq", "ord")
    return evaluation.clean_highlights(rows).select("filename", "ord", "text")
