"""Queries of the concept hierarchy, its vectors and the insertion of concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.frames import numbered, shared_path, written
from loomspark.operators import placement, store, taxonomy, vector_index, vectors
from loomspark.plans.registry import query, table
from loomspark.sources import elements as src
from loomspark.streaming import insertion


def _nodes(spark, sf_dir):
    """root -> region -> nation -> customer and supplier."""
    r, n, c, s = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    root = spark.range(1).selectExpr("'root' as node_id", "cast(null as string) as parent_id", "0 as child_ord", "'root' as name")
    rows = root.unionByName(r.selectExpr("concat('r', r_regionkey) as node_id", "'root' as parent_id", "cast(r_regionkey as int) as child_ord", "r_name as name"))
    rows = rows.unionByName(n.selectExpr("concat('n', n_nationkey) as node_id", "concat('r', n_regionkey) as parent_id", "cast(n_nationkey as int) as child_ord", "n_name as name"))
    rows = rows.unionByName(c.selectExpr("concat('c', c_custkey) as node_id", "concat('n', c_nationkey) as parent_id", "cast(2 * c_custkey as int) as child_ord", "c_name as name"))
    rows = rows.unionByName(s.selectExpr("concat('s', s_suppkey) as node_id", "concat('n', s_nationkey) as parent_id", "cast(2 * s_suppkey + 1 as int) as child_ord", "s_name as name"))
    return rows.selectExpr("*", "concat('about ', name) as definition", "'Original' as status", "cast(array() as array<string>) as standards", "cast(array() as array<string>) as alt_names", "cast(array() as array<string>) as alt_definitions")


_N = """
WITH RECURSIVE nodes AS (
  SELECT 'root' AS node_id, NULL AS parent_id, 0 AS child_ord, 'root' AS name
  UNION ALL SELECT 'r' || r_regionkey, 'root', r_regionkey::INT, r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::INT, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, (2 * c_custkey)::INT, c_name FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, (2 * s_suppkey + 1)::INT, s_name FROM supplier),
walk AS (SELECT node_id, 0 AS depth, child_ord::VARCHAR AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.node_id, w.depth + 1, w.path || '.' || n.child_ord FROM walk w JOIN nodes n ON n.parent_id = w.node_id),
kids AS (SELECT parent_id, string_agg(name, '; ' ORDER BY child_ord, name) AS children, count(*) AS n_children FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1)
"""


def _sheet(spark, sf_dir):
    """The hierarchy as a sheet: padded terms, suppliers that name their parent by its preferred
    name, repeated rows for nations, some ids and definitions missing."""
    n = _nodes(spark, sf_dir)
    up = n.selectExpr("node_id as p_id", "name as p_name")
    rows = n.join(up, n.parent_id == up.p_id, "left")
    rows = rows.selectExpr(
        "case when node_id like 's%' then '' else node_id end as ID", "concat('  ', name, ' ') as Term", "case when node_id like 'n%' then concat('known as ', name) else '' end as `Preferred name`",
        "case when child_ord % 3 = 1 then '' else definition end as Definition", "case when node_id like 's%' then concat(' known as ', p_name) else coalesce(p_name, '') end as `Parent name/Broader`",
        "'' as `Child name/Narrower`", "'sheet' as `Source name`", "case when node_id like 'r%' and child_ord % 2 = 1 then 'Corroborated' else '' end as Status",
        "case when node_id like 'r%' then 'a; b' else '' end as `Alternative Names`", "cast(case substring(node_id, 1, 1) when 'r' then 1 when 'n' then 2 when 'c' then 4 else 5 end as bigint) * 100000000 + child_ord as row_ord",
    )
    again = rows.filter("ID like 'n%'").withColumn("Definition", F.lit("again")).withColumn("row_ord", F.col("row_ord") + 100_000_000)
    return rows.unionByName(again)


@query(_N + """SELECT CASE WHEN node_id LIKE 's%' THEN sha256(name) ELSE node_id END AS node_id, name,
 CASE WHEN node_id LIKE 'n%' THEN 'again' WHEN child_ord % 3 = 1 THEN '' ELSE 'about ' || name END AS definition,
 CASE WHEN node_id LIKE 'r%' AND node_id <> 'root' AND child_ord % 2 = 1 THEN 'Corroborated' ELSE 'Original' END AS status,
 CASE WHEN node_id LIKE 'r%' THEN 'a|b' ELSE '' END AS alt_names FROM nodes""")
def e1_normalized_rows(spark, sf_dir):
    return taxonomy.normalize_rows(_sheet(spark, sf_dir)).select("node_id", "name", "definition", "status", store.pack_tags("alt_names").alias("alt_names"))


@query(_N + "SELECT n.name, p.name AS parent, false AS orphan FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_id")
def e2_resolved_parents(spark, sf_dir):
    n = taxonomy.resolve_parents(taxonomy.normalize_rows(_sheet(spark, sf_dir)))
    up = n.select(F.col("node_id").alias("p_id"), F.col("name").alias("parent"))
    return n.join(up, n.parent_id == up.p_id, "left").select(n.name, "parent", "orphan")


@query("""SELECT 'several roots' AS error, 'r' || r_regionkey AS node_id FROM region UNION ALL SELECT 'parent not found', 's' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0
UNION ALL SELECT 'in a cycle', 'c' || c_custkey FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'several roots', 'root'
UNION ALL SELECT 'not reachable', 'c' || a.c_custkey FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey - a.c_custkey % 10 WHERE a.c_custkey % 10 IN (1, 2) AND a.c_custkey > 2
UNION ALL SELECT 'not reachable', 'c' || c_custkey FROM customer WHERE c_custkey % 10 = 3 AND c_custkey // 10 * 10 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 0)""")
def e3_validated(spark, sf_dir):
    """Regions made roots; some suppliers without their parent and customers below them; some
    customers their own parents, others one and two levels below those."""
    key = "cast(substring(node_id, 2) as bigint)"
    parent = F.expr(f"""case when parent_id = 'root' then null when node_id like 's%' and {key} % 10 = 0 then 'nowhere' when node_id like 'c%' and {key} % 10 = 0 then node_id
        when node_id like 'c%' and {key} % 10 in (1, 2) and {key} > 2 then concat('c', {key} - 1) when node_id like 'c%' and {key} % 10 = 3 and s_suppkey > 0 then concat('s', s_suppkey) else parent_id end""")
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = _nodes(spark, sf_dir).join(s, F.expr(f"case when node_id like 'c%' then {key} div 10 * 10 end") == F.col("s_suppkey"), "left")
    return taxonomy.validate(n.withColumn("parent_id", parent).drop("s_suppkey"))


@query(_N + "SELECT node_id, depth, 'root' AS top, false AS in_cycle FROM walk")
def e4_ancestors(spark, sf_dir):
    return taxonomy.ancestors(_nodes(spark, sf_dir))


@query(_N + "SELECT node_id, depth, path FROM walk")
def e4_preorder(spark, sf_dir):
    out = taxonomy.preorder(_nodes(spark, sf_dir))
    return out.select("node_id", "depth", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query(_N + "SELECT parent_id AS node_id, children, n_children FROM kids")
def e5_children(spark, sf_dir):
    return taxonomy.children_names(_nodes(spark, sf_dir))


@query(_N + """, lines AS (SELECT node_id, 0 AS depth, '' AS inner_, true AS is_last FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.node_id, w.depth + 1, CASE WHEN w.depth = 0 THEN '' WHEN w.is_last THEN w.inner_ || '    ' ELSE w.inner_ || '│   ' END,
         n.child_ord = (SELECT max(child_ord) FROM nodes m WHERE m.parent_id = n.parent_id) FROM lines w JOIN nodes n ON n.parent_id = w.node_id)
SELECT node_id, inner_ || CASE WHEN depth = 0 THEN '' WHEN is_last THEN '└── ' ELSE '├── ' END || name AS line FROM lines JOIN nodes USING (node_id)""")
def e6_render(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return taxonomy.render(n, taxonomy.preorder(n)).drop("path")


@query(_N + "SELECT node_id, name FROM nodes WHERE node_id IN (SELECT 'n' || s_nationkey FROM supplier WHERE s_suppkey % 20 = 0)")
def e7_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").filter("s_suppkey % 20 = 0").selectExpr("concat('n', s_nationkey) as node_id")
    return store.by_keys(_nodes(spark, sf_dir), keys, "node_id").select("node_id", "name")


@query(_N + """SELECT n.node_id, p.name AS parent, 'about ' || p.name AS parent_definition, coalesce(s.siblings, '') AS siblings, coalesce(k.children, '') AS children
FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_id LEFT JOIN kids k ON k.parent_id = n.node_id
LEFT JOIN (SELECT a.node_id, string_agg(b.name, '; ' ORDER BY b.child_ord) AS siblings FROM nodes a JOIN nodes b ON a.parent_id = b.parent_id AND a.node_id <> b.node_id GROUP BY 1) s ON s.node_id = n.node_id""")
def e8_neighbourhood(spark, sf_dir):
    out = taxonomy.neighbourhood(_nodes(spark, sf_dir))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), "; ").alias(c)
    return out.select("node_id", F.col("parent.name").alias("parent"), F.col("parent.definition").alias("parent_definition"), names("siblings"), names("children"))


@query(_N + """SELECT n.node_id, CASE WHEN n.child_ord % 3 = 1 THEN CASE WHEN p.name IS NULL THEN 'A top-level concept' ELSE 'A kind of ' || p.name END || coalesce(' that covers ' || replace(k.children, '; ', ', '), '') || '.'
 ELSE 'about ' || n.name END AS definition, CASE WHEN n.child_ord % 3 = 1 THEN 'sheet (LLM-generated definition)' ELSE 'sheet' END AS source_name
FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_id LEFT JOIN kids k ON k.parent_id = n.node_id""")
def e9_filled_definitions(spark, sf_dir):
    n = _nodes(spark, sf_dir).withColumn("definition", F.expr("case when child_ord % 3 = 1 then '' else definition end")).withColumn("Source name", F.lit("sheet"))
    return placement.fill_definitions(n).select("node_id", "definition", F.col("Source name").alias("source_name"))


@query(_N + "SELECT node_id, name || ': about ' || name AS doc FROM nodes")
def e10_node_documents(spark, sf_dir):
    return _nodes(spark, sf_dir).select("node_id", taxonomy.node_document().alias("doc"))


@query(r"""WITH w AS (SELECT doc_id, ('0x' || substr(md5(unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))), 1, 12))::BIGINT AS h FROM documents),
v AS (SELECT doc_id, ((h // 2) % 64)::INT AS dim, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL)
SELECT doc_id, dim, sign(x)::INT AS sign FROM v WHERE x <> 0""")
def e11_embedded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = vectors.embed_once(docs, "text", shared_path(spark, "embeddings"))
    rows = out.select("doc_id", F.posexplode("embedding").alias("dim", "x")).filter("x <> 0")
    return rows.select("doc_id", "dim", F.signum("x").cast("int").alias("sign"))


@query("""SELECT vec_id::VARCHAR AS node_id, CASE WHEN vec_id % 7 = 0 THEN 'missing' ELSE 'extra' END AS what FROM embeddings WHERE (vec_id % 7 = 0) <> (vec_id % 5 = 0)""")
def e12_index_sync(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").selectExpr("cast(vec_id as string) as node_id", "vec_id")
    return vectors.out_of_sync(e.filter("vec_id % 5 <> 0 or vec_id % 7 = 0"), e.filter("vec_id % 7 <> 0 or vec_id % 5 = 0"))


@query(r"""WITH w AS (SELECT doc_id, ('0x' || substr(md5(unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))), 1, 12))::BIGINT AS h FROM documents WHERE doc_id % 5 <> 0),
v AS (SELECT doc_id, ((h // 2) % 64)::INT AS dim, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL),
n AS (SELECT doc_id, sum(x * x) AS n, sum(dim * x) AS s FROM v GROUP BY 1)
SELECT d.doc_id::VARCHAR AS node_id, CASE WHEN d.doc_id % 7 = 0 THEN 'missing' WHEN d.doc_id % 3 = 0 THEN 'changed' ELSE 'kept' END AS what,
       CASE WHEN d.doc_id % 7 = 0 OR d.doc_id % 3 = 0 THEN round(coalesce(s / nullif(sqrt(n), 0), 0), 2) ELSE 0 END::DOUBLE AS weight
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id WHERE d.doc_id % 5 <> 0""")
def e12_synchronised(spark, sf_dir):
    """An index that lacks some documents, has some with another text and some too many, brought
    in step; weight sums a vector's components times their numbers (kept entries hold zeros)."""
    d = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as node_id", "doc_id", "coalesce(text, '') as doc")
    old = d.filter("doc_id % 5 = 0 or doc_id % 7 <> 0").select("node_id", F.when(F.expr("doc_id % 3 = 0"), "old").otherwise(vectors.content_hash()).alias("doc_hash"), F.expr("array_repeat(cast(0 as float), 64)").alias("embedding"))
    out = vectors.synchronised(d.filter("doc_id % 5 <> 0").select("node_id", "doc"), old, shared_path(spark, "embeddings"))
    weight = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x)
    return out.select("node_id", "what", (F.round(weight, 2) + 0.0).alias("weight"))


_DISTANCE = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE)))"


_NEAREST = f"""
WITH p AS (SELECT q.vec_id AS query_id, t.vec_id AS node_id, {_DISTANCE} AS d FROM embeddings q, embeddings t WHERE q.vec_id % 20 = 0)
SELECT query_id, node_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id) AS rank FROM p) WHERE rank <= 3"""


@query(_NEAREST)
def e13_nearest_nodes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = vectors.nearest_nodes(e.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding"), e.selectExpr("vec_id as node_id", "embedding"), 3)
    return out.select("query_id", "node_id", "rank")


@query(_NEAREST)
def e13_indexed_nodes(spark, sf_dir):
    """The same search through a written index of cells."""
    e = table(spark, sf_dir, "embeddings")
    index = vector_index.build_index(e.selectExpr("vec_id as node_id", "embedding"), shared_path(spark, "index"))
    out = vector_index.nearest_in_index(e.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding"), index, 3)
    return out.select("query_id", "node_id", "rank")


@query(f"""
WITH p AS (SELECT q.vec_id AS query_id, t.vec_id AS node_id, {_DISTANCE} AS d, 'vector ' || t.vec_id AS doc FROM embeddings q, embeddings t WHERE q.vec_id % 20 = 0 AND t.vec_id % 3 = 1)
SELECT query_id, node_id, round(sqrt(d), 6) AS distance, doc FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id) AS rank FROM p) WHERE rank <= 2""")
def e13_filtered_nodes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nodes = e.selectExpr("vec_id as node_id", "embedding", "concat('vector ', vec_id) as doc", "vec_id % 3 as kind")
    out = vectors.nearest_nodes(e.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding"), nodes, 2, F.col("kind") == 1, "l2")
    return out.select("query_id", "node_id", F.round("distance", 6).alias("distance"), "doc")


@query(_N + """SELECT n.node_id AS id, n.name AS term, coalesce(p.name, '') AS parent, coalesce(c.children, '') AS children, 'Original' AS status FROM nodes n
LEFT JOIN nodes p ON n.parent_id = p.node_id LEFT JOIN kids c ON c.parent_id = n.node_id""")
def e14_export(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    out = placement.export_rows(n, taxonomy.preorder(n))
    return out.select(F.col("ID").alias("id"), F.col("Term").alias("term"), F.col("Parent name/Broader").alias("parent"), F.col("Child name/Narrower").alias("children"), F.col("Status").alias("status"))


@query(_N + """SELECT n.node_id AS id, n.name AS term, coalesce(p.name, '') AS parent, coalesce(c.children, '') AS children, CASE WHEN n.node_id LIKE 'n%' THEN 'Corroborated' ELSE 'Original' END AS status,
 CASE WHEN n.node_id LIKE 'n%' THEN 'also, "' || n.name || '"; other' ELSE '' END AS names, row_number() OVER (ORDER BY list_transform(string_split(w.path, '.'), lambda x: x::INT)) - 1 AS place
FROM nodes n JOIN walk w ON w.node_id = n.node_id LEFT JOIN nodes p ON n.parent_id = p.node_id LEFT JOIN kids c ON c.parent_id = n.node_id""")
def a5_a7_sheet_round_trip(spark, sf_dir):
    """The export written as CSV, read, normalised, grown and exported again: nothing changes."""
    n = _nodes(spark, sf_dir)
    n = n.withColumn("alt_names", F.expr("case when node_id like 'n%' then array(concat('also, \"', name, '\"'), 'other') else alt_names end"))
    n = n.withColumn("status", F.expr("case when node_id like 'n%' then 'Corroborated' else status end"))
    path = shared_path(spark, "sheet")
    src.write_taxonomy(placement.export_rows(n, taxonomy.preorder(n)), path)
    rows = written(src.read_taxonomy(spark, path), "sheet-rows")
    again = written(taxonomy.grow(taxonomy.normalize_rows(rows)), "sheet-grown")
    out = placement.export_rows(again, taxonomy.preorder(again))
    return numbered(out, "path", name="place").select(F.col("ID").alias("id"), F.col("Term").alias("term"), F.col("Parent name/Broader").alias("parent"), F.col("Child name/Narrower").alias("children"), F.col("Status").alias("status"), F.col("Alternative Names").alias("names"), F.col("place").cast("long").alias("place"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 100 < 50 THEN 'Reject' WHEN o_orderkey % 100 >= 65 THEN 'Merge' ELSE 'Insert' END AS result,
CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN 'node ' || o_custkey END AS best FROM orders""")
def e15_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "case when o_orderkey % 11 = 0 then '' else 'n' end as name", "case when o_orderkey % 13 = 0 then null else 'd' end as definition",
        "concat('node ', o_custkey) as node", "case when o_orderkey % 17 <> 0 then o_orderkey % 100 / 100 end as similarity",
    )
    return taxonomy.decide(o).select("id", "result", F.col("best_matching_node.name").alias("best"))


@query(r"""
SELECT 'n' || s_nationkey AS node_id, count(*) AS n_names, string_agg(s_name, '|' ORDER BY s_suppkey) AS alt_names, 'Corroborated' AS status FROM supplier GROUP BY s_nationkey""")
def e16_merge(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("concat('n', s_nationkey) as node_id", "s_suppkey as concept_seq", "s_name as name", "s_name as definition", "'suppliers' as filename", "1 as page_number")
    out = taxonomy.merge_concepts(_nodes(spark, sf_dir), s).filter("status = 'Corroborated'")
    return out.select("node_id", F.size("alt_names").cast("long").alias("n_names"), F.array_join("alt_names", "|").alias("alt_names"), "status")


def _suppliers(spark, sf_dir):
    """Suppliers as new concepts for their nations."""
    return table(spark, sf_dir, "supplier").selectExpr("concat('new', s_suppkey) as concept_id", "concat('n', s_nationkey) as node_id", "s_suppkey as concept_seq", "s_name as name", "'said' as definition", "concat('file', s_suppkey % 3) as filename", "cast(s_suppkey % 7 as int) as page_number")


@query(_N + """SELECT node_id, parent_id, child_ord, 'Original' AS status, 'sheet' AS source_name, '' AS standards FROM nodes UNION ALL
SELECT 'new' || s_suppkey, 'n' || s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + (SELECT max(child_ord) FROM nodes WHERE parent_id = 'n' || s_nationkey))::INT, 'Introduced', 'file' || s_suppkey % 3,
       'file' || s_suppkey % 3 || ' (p. ' || s_suppkey % 7 || ')' FROM supplier""")
def e17_inserted_children(spark, sf_dir):
    n = _nodes(spark, sf_dir).withColumn("Source name", F.lit("sheet"))
    out = taxonomy.insert_children(n, _suppliers(spark, sf_dir))
    return out.select("node_id", "parent_id", "child_ord", "status", F.col("Source name").alias("source_name"), store.pack_tags("standards").alias("standards"))


@query(_N + """, s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS up, max(s_suppkey) OVER (PARTITION BY s_nationkey) AS low FROM supplier)
SELECT n.node_id, CASE WHEN s.low IS NOT NULL THEN 'new' || s.low ELSE n.parent_id END AS parent_id FROM nodes n LEFT JOIN (SELECT DISTINCT s_nationkey, low FROM s) s ON n.node_id = 'n' || s.s_nationkey
UNION ALL SELECT 'new' || s_suppkey, CASE WHEN r = 1 THEN 'r' || n_regionkey ELSE 'new' || up END FROM s JOIN nation ON n_nationkey = s_nationkey""")
def e18_inserted_parents(spark, sf_dir):
    return taxonomy.insert_parents(_nodes(spark, sf_dir), _suppliers(spark, sf_dir)).select("node_id", "parent_id")


@query(f"""
WITH e AS (SELECT vec_id, embedding, CASE WHEN vec_id = 0 THEN NULL ELSE vec_id // 10 END AS parent FROM embeddings),
c AS (SELECT q.vec_id AS concept, n.vec_id AS node, n.parent, q.embedding FROM embeddings q JOIN e n ON n.vec_id = q.vec_id // 3 WHERE q.vec_id % 20 = 0),
d AS (SELECT q.concept, t.vec_id IS NOT DISTINCT FROM q.parent AS up, 1 - {_DISTANCE} AS s FROM c q JOIN e t ON t.vec_id = q.parent OR (t.parent = q.parent AND t.vec_id <> q.node)),
m AS (SELECT concept, max(s) FILTER (up) AS p, max(s) FILTER (NOT up) AS s FROM d GROUP BY 1)
SELECT c.concept::VARCHAR AS concept_id, CASE WHEN p >= -0.5 AND p > coalesce(s, -1e9) THEN 'parent' WHEN s >= -0.5 AND s > coalesce(p, -1e9) THEN 'sibling' ELSE 'child' END AS placement
FROM c LEFT JOIN m ON c.concept = m.concept""")
def e19_placement(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.selectExpr("cast(vec_id as string) as node_id", "cast(case when vec_id > 0 then vec_id div 10 end as string) as parent_id", "embedding")
    c = e.filter("vec_id % 20 = 0").selectExpr("cast(vec_id as string) as concept_id", "cast(vec_id div 3 as string) as node_id", "embedding")
    return placement.compare_placement(c, n, -0.5).select("concept_id", "placement")


def _vector_tree(spark, sf_dir):
    """embeddings as concepts (id divisible by 20) and as a hierarchy (all others)."""
    e = table(spark, sf_dir, "embeddings")
    lists = [f"cast(array() as array<string>) as {c}" for c in ("standards", "alt_names", "alt_definitions")]
    nodes = e.filter("vec_id % 20 <> 0").selectExpr("cast(vec_id as string) as node_id", "vec_id as ord", "cast(case when vec_id > 1 then 1 end as string) as parent_id", "cast(vec_id as int) as child_ord", "concat('node ', vec_id) as name", "'known' as definition", "'Original' as status", *lists, "embedding")
    concepts = e.filter("vec_id % 20 = 0").selectExpr("concat('c', vec_id) as concept_id", "vec_id as seq", "concat('concept ', vec_id) as name", "case when vec_id % 140 = 0 then '' else 'defined' end as definition", "'file' as filename", "cast(vec_id % 9 as int) as page_number", "embedding")
    return nodes, concepts


#: Decisions one concept after the other. b: distance and ord to the best node; cc: to the concepts before.
_ORDER = f"""
WITH RECURSIVE c AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS i, vec_id % 140 = 0 AS bad FROM embeddings WHERE vec_id % 20 = 0),
b AS (SELECT q.i, min(struct_pack(d := {_DISTANCE}, o := t.vec_id)) AS near FROM c q JOIN embeddings t ON t.vec_id % 20 <> 0 GROUP BY q.i),
cc AS (SELECT q.i, list(struct_pack(d := {_DISTANCE}, o := t.vec_id + 1099511627776)) AS near FROM c q JOIN c t ON t.i < q.i GROUP BY q.i),
x AS (SELECT c.i, c.vec_id, c.bad, b.near AS b, coalesce(cc.near, []) AS cc FROM c JOIN b USING (i) LEFT JOIN cc USING (i)),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS seq, NULL::STRUCT(d DOUBLE, o BIGINT) AS near, []::BIGINT[] AS ins, false AS bad
      UNION ALL
      SELECT i, vec_id, near, CASE WHEN NOT bad AND 1 - near.d >= -0.40 AND 1 - near.d < -0.30 THEN list_append(ins, vec_id + 1099511627776) ELSE ins END, bad
      FROM (SELECT x.i, x.vec_id, x.bad, r.ins, list_min(list_append(list_filter(x.cc, lambda y: list_contains(r.ins, y.o)), x.b)) AS near FROM r JOIN x ON x.i = r.i + 1)),
dec AS (SELECT seq, CASE WHEN NOT bad THEN near.o END AS ord, CASE WHEN bad OR 1 - near.d < -0.40 THEN 'Reject' WHEN 1 - near.d >= -0.30 THEN 'Merge' ELSE 'Insert' END AS result FROM r WHERE i > 0)
"""
_SNAPSHOT = f"""
WITH b AS (SELECT q.vec_id AS seq, min(struct_pack(d := {_DISTANCE}, o := t.vec_id)) AS near FROM embeddings q JOIN embeddings t ON t.vec_id % 20 <> 0 WHERE q.vec_id % 20 = 0 GROUP BY 1),
dec AS (SELECT seq, near.o AS ord, CASE WHEN seq % 140 = 0 OR 1 - near.d < -0.40 THEN 'Reject' WHEN 1 - near.d >= -0.30 THEN 'Merge' ELSE 'Insert' END AS result FROM b)
"""


@query(_SNAPSHOT + """, m AS (SELECT ord, string_agg('concept ' || seq, '|' ORDER BY seq) AS names FROM dec WHERE result = 'Merge' GROUP BY 1)
SELECT vec_id::VARCHAR AS node_id, CASE WHEN vec_id > 1 THEN '1' END AS parent_id, coalesce(m.names, '') AS alt_names, CASE WHEN m.ord IS NULL THEN 'Original' ELSE 'Corroborated' END AS status
FROM embeddings LEFT JOIN m ON m.ord = vec_id WHERE vec_id % 20 <> 0 UNION ALL SELECT 'c' || seq, ord::VARCHAR, '', 'Introduced' FROM dec WHERE result = 'Insert'""")
def e20_snapshot_insertion(spark, sf_dir):
    nodes, concepts = _vector_tree(spark, sf_dir)
    after = placement.insert_snapshot(nodes, concepts, -0.40, -0.30)[1]
    return after.select("node_id", "parent_id", store.pack_tags("alt_names").alias("alt_names"), "status")


@query(_ORDER + "SELECT * FROM dec")
def e21_ordered_decisions(spark, sf_dir):
    nodes, concepts = _vector_tree(spark, sf_dir)
    return placement.decide_in_order(concepts, nodes.select("ord", "embedding"), -0.40, -0.30).drop("similarity")


@query(_SNAPSHOT + "SELECT seq % 9 AS page_number, count(*) FILTER (result = 'Reject') AS n_reject, count(*) FILTER (result = 'Merge') AS n_merge, count(*) FILTER (result = 'Insert') AS n_insert FROM dec GROUP BY 1")
def e22_decision_summary(spark, sf_dir):
    nodes, concepts = _vector_tree(spark, sf_dir)
    decided = placement.insert_snapshot(nodes, concepts, -0.40, -0.30)[0]
    return taxonomy.decision_summary(decided, "page_number").withColumn("page_number", F.col("page_number").cast("long"))


@query(_ORDER + "SELECT * FROM dec")
def g1_stream_insertion(spark, sf_dir):
    """The concepts as a stream of files, applied to a hierarchy that is kept as versions."""
    nodes, concepts = _vector_tree(spark, sf_dir)
    root, source = shared_path(spark, "stream"), shared_path(spark, "stream-in")
    insertion.start_hierarchy(nodes, root)
    concepts.write.parquet(source)
    insertion.insert_stream(spark.readStream.schema(concepts.schema).parquet(source), root, -0.40, -0.30).awaitTermination()
    return spark.read.parquet(f"{root}/decisions/b*").drop("similarity")
