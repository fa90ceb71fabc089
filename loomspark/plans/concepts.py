"""Queries of concept extraction and of the keyed store."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from loomspark.functions.frames import shared_path, written
from loomspark.operators import chunking, concepts, store, versions
from loomspark.plans.documents import B13_SQL, elements
from loomspark.plans.registry import query, table


def _chunks(spark, sf_dir):
    return written(chunking.chunk_documents(elements(spark, sf_dir)), "chunks")


@query(B13_SQL + """SELECT id, '{''text'': ' || text || ', ''metadata'':{''page_tags'': [' || coalesce('''' || array_to_string(pl.tags, ''', ''') || '''', '') || ']}}' AS prompt
FROM ch LEFT JOIN pl USING (filename, page_number)""")
def c1_prompts(spark, sf_dir):
    return concepts.prompts(_chunks(spark, sf_dir)).select("id", "prompt")


def _first_word(prompts: pd.Series) -> pd.Series:
    """A stand-in for a model: the first word and the whole text."""
    texts = prompts.str.removeprefix("{'text': ").str.replace(r", 'metadata':\{'page_tags': \[.*\]\}\}$", "", regex=True)
    return texts.map(lambda t: json.dumps([{"term": t.split()[0], "definition": t}]))


@query(B13_SQL + r"SELECT id AS chunk_id, regexp_extract(text, '^\s*(\S+)', 1) AS term, text AS definition FROM ch")
def c2_extracted(spark, sf_dir):
    out = concepts.extract(_chunks(spark, sf_dir), _first_word, shared_path(spark, "answers"), "first-word")
    return concepts.parse_responses(out).select("chunk_id", "term", "definition")


_RULES = B13_SQL + rf""", st AS (SELECT filename, chunk_seq, page_number, id, page_tags, regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?]+|\n\n') AS ss FROM ch),
ss AS (SELECT filename, chunk_seq, page_number, id, page_tags, ss AS tokens, trim(unnest(ss)) AS s, unnest(range(len(ss)))::INT AS item_seq FROM st),
pp AS (SELECT *, CASE WHEN regexp_matches(s, '{concepts.IS_A}') THEN 1 WHEN regexp_matches(s, '{concepts.MEANS}') THEN 2
                  WHEN len(list_filter(string_split(page_tags, '|'), lambda t: lower(t) IN ('lexicon', 'acronyms', 'abbreviations', 'terms', 'definitions'))) > 0 AND regexp_matches(s, '{concepts.GLOSSARY}') THEN 3
                  WHEN item_seq > 0 AND regexp_matches(s, '{concepts.NAMED}') AND lower(regexp_extract(s, '{concepts.NAMED}', 1)) = lower(regexp_replace(trim(tokens[item_seq]), '[.!?]+$', '')) THEN 4 END AS k FROM ss),
qq AS (SELECT *, CASE k WHEN 1 THEN regexp_extract(s, '{concepts.IS_A}', 1) WHEN 2 THEN regexp_extract(s, '{concepts.MEANS}', 1) WHEN 3 THEN regexp_extract(s, '{concepts.GLOSSARY}', 1) ELSE regexp_extract(s, '{concepts.NAMED}', 1) END AS a,
                 CASE k WHEN 1 THEN regexp_extract(s, '{concepts.IS_A}', 2) WHEN 2 THEN regexp_extract(s, '{concepts.MEANS}', 2) WHEN 3 THEN regexp_extract(s, '{concepts.GLOSSARY}', 2) ELSE regexp_extract(s, '{concepts.NAMED}', 2) END AS b FROM pp WHERE k IS NOT NULL),
rc AS (SELECT filename, chunk_seq, page_number, id AS chunk_id, item_seq, upper(a[1]) || a[2:] AS name, upper(b[1]) || b[2:] AS definition FROM qq)
"""


@query(_RULES + "SELECT filename, chunk_seq, page_number, name, definition FROM rc")
def c3_rule_concepts(spark, sf_dir):
    return concepts.rule_concepts(_chunks(spark, sf_dir)).drop("item_seq")


@query(_RULES + "SELECT chunk_id, page_number, filename, name AS term, definition FROM rc")
def c6_provenance(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    items = concepts.parse_responses(concepts.rule_responses(chunks)).filter("term is not null")
    return concepts.with_provenance(items, chunks).select("chunk_id", "page_number", "filename", "term", "definition")


def _responses(spark, sf_dir):
    """Conversations as responses: one item a turn, some malformed."""
    c = table(spark, sf_dir, "conversations")
    item = F.to_json(F.array(F.struct(F.col("role").alias("term"), F.col("text").alias("definition"))))
    body = F.when(F.col("turn") % 5 == 4, "[{").otherwise(item)
    return c.select(F.col("conv_id").cast("string").alias("filename"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("chunk_seq"), body.alias("response"))


@query("SELECT conv_id || '-' || turn AS chunk_id, turn % 5 = 4 AS bad, CASE WHEN turn % 5 <> 4 THEN role END AS term FROM conversations")
def c4_parsed_responses(spark, sf_dir):
    return concepts.parse_responses(_responses(spark, sf_dir)).select("chunk_id", "bad", "term")


@query("SELECT conv_id::VARCHAR AS filename, role AS term, arg_max(text, turn) AS definition FROM conversations WHERE turn % 5 <> 4 AND role <> '' GROUP BY ALL")
def c5_flatten_terms(spark, sf_dir):
    return concepts.flatten_terms(concepts.parse_responses(_responses(spark, sf_dir)))


@query("SELECT conv_id::VARCHAR AS filename, count(*) AS n_concepts FROM conversations WHERE turn % 5 <> 4 GROUP BY 1")
def c7_concept_counts(spark, sf_dir):
    return concepts.concept_counts(concepts.parse_responses(_responses(spark, sf_dir)).filter("not bad"))


@query("SELECT arg_max(text, conv_id * 1000 + turn) AS result FROM conversations WHERE turn % 3 = 0 AND (conv_id + turn) % 4 <> 3")
def c8_progress_result(spark, sf_dir):
    """Conversations as a progress log: some lines are no data, some are malformed."""
    c = table(spark, sf_dir, "conversations")
    event = F.to_json(F.struct(F.when(F.col("turn") % 3 == 0, "complete").otherwise("progress").alias("type"), F.col("text").alias("data")))
    value = F.when(F.expr("(conv_id + turn) % 4 = 3"), F.concat(F.lit(" data: {"), event)).otherwise(F.concat(F.lit("\t data: "), event, F.lit(" \r")))
    return concepts.progress_result(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), value.alias("value")))


_UPSERT = """WITH b AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT max(k) AS top FROM b),
f AS (SELECT k AS id, k AS place FROM b WHERE k % 3 = 0 UNION ALL SELECT -k, 1000000000000 + k FROM b WHERE k % 3 = 0 AND k > 0)
SELECT id, 'new' AS state, (top + row_number() OVER (ORDER BY place))::BIGINT AS ord FROM f, t UNION ALL SELECT k, 'old', k FROM b WHERE k % 3 <> 0"""


def _orders(spark, sf_dir):
    """Orders as rows of a keyed table; and a batch that replaces some twice and adds others."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    some = o.filter("id % 3 = 0")
    row = lambda df, state, key, step: df.select(F.expr(key).alias("id"), F.lit(state).alias("state"), (F.lit(step * 10**12) + F.abs("id")).alias("ord"))
    batch = row(some, "first", "id", 0).unionByName(row(some, "new", "id", 1)).unionByName(row(some.filter("id > 0"), "new", "-id", 2))
    return row(o, "old", "id", 0), batch


@query(_UPSERT)
def d1_upsert(spark, sf_dir):
    """Replaced and new rows come last."""
    return store.upsert(*_orders(spark, sf_dir))


@query("SELECT id, state, ord, 1 AS version FROM (" + _UPSERT + ")")
def d1_versioned(spark, sf_dir):
    """The same in a table of versions; a batch that comes again changes nothing."""
    base, batch = _orders(spark, sf_dir)
    kept = versions.VersionedTable(spark, shared_path(spark, "orders"))
    kept.create(base)
    kept.upsert(batch, "batch-1")
    return kept.rows(kept.upsert(batch, "batch-1")).withColumn("version", F.lit(kept.latest()))


def _rows(spark, sf_dir):
    """Order lines as a keyed table: an order is a document."""
    return table(spark, sf_dir, "lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) as id", "cast(l_orderkey as string) as filename", "cast(l_partkey as string) as chunk_id", "l_orderkey * 10 + l_linenumber as ord")


_L = "SELECT l_orderkey || '-' || l_linenumber AS id FROM lineitem "


@query(_L + "WHERE l_linenumber = 1 AND l_orderkey % 20 = 0")
def d2_get(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").selectExpr("concat(o_orderkey, '-1') as id", "o_orderkey").filter("o_orderkey % 20 = 0")
    return store.by_keys(_rows(spark, sf_dir), keys, "id").select("id")


@query(_L + "WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem WHERE l_linenumber = 3) ORDER BY l_linenumber LIMIT 2 OFFSET 1")
def d3_by_document(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    name = rows.filter("ord % 10 = 3").agg(F.max(F.col("filename").cast("long"))).first()[0]
    return store.by_document(rows, str(name), 2, 1).select("id")


@query(_L + "WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 20 = 0)")
def d4_by_chunk(spark, sf_dir):
    keys = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").selectExpr("cast(p_partkey as string) as chunk_id")
    return store.by_keys(_rows(spark, sf_dir), keys, "chunk_id").select("id")


@query(_L + "WHERE NOT (l_linenumber = 1 AND l_orderkey % 20 = 0)")
def d5_delete(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").selectExpr("concat(o_orderkey, '-1') as id")
    return store.delete(_rows(spark, sf_dir), keys).select("id")


@query(_L + "WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 0)")
def d6_delete_documents(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").selectExpr("cast(o_orderkey as string) as filename")
    return store.delete(_rows(spark, sf_dir), keys, "filename").select("id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def d7_retention(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    return store.retain(e.join(F.broadcast(now)), 7, F.col("now"), "ts").select("event_id")


@query(_L + "WHERE false")
def d8_truncate(spark, sf_dir):
    return store.truncate(_rows(spark, sf_dir)).select("id")


@query("SELECT l_orderkey AS id, string_agg(l_returnflag || l_linestatus, '|' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS packed, count(*) AS n_tags FROM lineitem GROUP BY 1")
def d9_pack_tags(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    tags = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("t")))), lambda x: x["t"])
    packed = li.groupBy(F.col("l_orderkey").alias("id")).agg(tags.alias("tags")).select("id", store.pack_tags("tags").alias("packed"))
    return packed.withColumn("n_tags", F.size(store.unpack_tags("packed")).cast("long"))
