"""Where concepts go in the hierarchy: order-equivalent insertion, placement beside the best
node, filled definitions, and the export sheet."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.frames import shared_path, written
from loomspark.functions.graph import components
from loomspark.operators import calls, taxonomy, vectors

#: Inserted concepts rank after every node of the hierarchy.
AFTER_NODES = 1 << 40


def _within(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs of rows of left and right nearer than left's limit, and that right may precede."""
    out = {"j": [np.zeros(0, np.int64)], "i": [np.zeros(0, np.int64)], "d": [np.zeros(0)]}
    if len(left) and len(right):
        x, t = vectors.matrix(left["embedding"]), vectors.matrix(right["embedding"])
        limit, last, g, first = left["limit"].to_numpy(), left["last"].to_numpy(), left["g"].to_numpy(), right["g"].to_numpy()
        norms = (t * t).sum(1)
        for lo in range(0, len(x), vectors.SLICE_ROWS):
            part = x[lo : lo + vectors.SLICE_ROWS]
            own, at = (part * part).sum(1), slice(lo, lo + len(part))
            d = own[:, None] + norms[None, :] - 2 * part @ t.T
            margin = 1e-9 * (own + norms.max() + 1)
            i, j = np.nonzero((d <= (limit[at] + margin)[:, None]) & (first[None, :] < last[at, None]) & (first[None, :] != g[at, None]))
            exact = ((part[i] - t[j]) ** 2).sum(1)
            keep = exact < limit[at][i]
            for c, v in (("j", g[at][i]), ("i", first[j]), ("d", exact)):
                out[c].append(v[keep])
    return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})


#: Rounds over all waiting concepts, before what is left is finished component by component.
ROUNDS = 5


def _one_after_the_other(reject: float, merge: float):
    """Decides concepts in order. Rows: root, seq, g, d, o (best node so far), i, e (a nearer
    group that may hold an inserted concept, and how near; null if none), sorted by root and seq.
    What is kept is the inserted groups of one root and the row under way."""

    def run(batches):
        root, seq, inserted, g, best = None, None, {}, None, None

        def settled():
            s = 1 - best[0]
            result = "Reject" if s < reject else "Merge" if s >= merge else "Insert"
            if result == "Insert":
                inserted.setdefault(g, seq)
            return seq, best[1], s, result

        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if (r.root, r.seq) != (root, seq):
                    if seq is not None:
                        out.append(settled())
                    if r.root != root:
                        inserted = {}
                    root, seq, g, best = r.root, r.seq, r.g, (r.d, r.o)
                if r.i in inserted:  # a null is in no set
                    best = min(best, (r.e, AFTER_NODES + inserted[r.i]))
            yield pd.DataFrame(out, columns=["seq", "ord", "similarity", "result"])
        if seq is not None:
            yield pd.DataFrame([settled()], columns=["seq", "ord", "similarity", "result"])

    return run


def _offered(waiting: DataFrame, edges: DataFrame, state: DataFrame) -> DataFrame:
    """waiting (seq, g, best) with the nearest earlier inserted concept taken into best, and
    rival, the nearest earlier one that is not settled. state: i, since, pending: first inserted
    and first unsettled concept of a group."""
    reach = waiting.join(edges.join(state, "i").withColumnRenamed("j", "g"), "g")
    node = lambda at: F.min(F.when(F.col(at) < F.col("seq"), F.struct("d", (F.col(at) + AFTER_NODES).alias("o"))))
    told = reach.groupBy("seq").agg(node("since").alias("better"), node("pending").alias("rival"))
    return waiting.join(told, "seq", "left").select("seq", "g", F.least("best", "better").alias("best"), "rival")


_DECIDED = "seq long, ord long, similarity double, result string"


def decide_in_order(concepts: DataFrame, nodes: DataFrame, reject: float = taxonomy.REJECT, merge: float = taxonomy.MERGE) -> DataFrame:
    """concepts: seq (unique), name, definition, embedding; nodes: ord, embedding. The decisions
    of inserting one concept after the other, an inserted one being a possible best node of all
    later ones: seq, ord (best node; AFTER_NODES + seq for an inserted concept), similarity, result.

    Equal vectors form a group. Vectors are compared twice: groups with nodes, then groups with
    groups, which leaves an edge where a group that may be inserted is nearer than the best node.
    What follows handles these numbers only. ROUNDS rounds settle every concept whose best node
    so far is nearer than any unsettled earlier concept; the components of the rest are then
    each walked in order. Concepts without name or definition are rejected without a best node,
    as are all if there are no nodes. An empty table gives no rows."""
    empty = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("definition", F.lit("")) == "") | F.col("embedding").isNull()
    blank = concepts.filter(empty).select("seq", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("double").alias("similarity"), F.lit("Reject").alias("result"))
    filled = written(concepts.filter(~empty).select("seq", "embedding"), "order-concepts")
    groups = written(filled.groupBy("embedding").agg(F.min("seq").alias("g"), F.max("seq").alias("last")), "order-groups")
    near = vectors.nearest_nodes(groups.select(F.col("g").alias("query_id"), "embedding"), nodes.select(F.col("ord").alias("node_id"), "embedding"))
    near = near.select(F.col("query_id").alias("g"), F.struct(F.col("distance").alias("d"), F.col("node_id").alias("o")).alias("best"))
    groups = written(groups.join(near, "g", "left"), "order-near")
    lost = groups.filter("best is null")
    waiting = filled.join(groups.select("embedding", "g", "best"), "embedding").select("seq", "g", "best")
    alone = waiting.filter("best is null").select("seq", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("double").alias("similarity"), F.lit("Reject").alias("result"))
    out = blank if lost.isEmpty() else blank.unionByName(alone)
    waiting = written(waiting.filter("best is not null"), "order-waiting")

    live = groups.filter("best is not null")
    pairs = vectors.in_blocks(live.select("g", "last", F.col("best.d").alias("limit"), "embedding"), "g", live.filter(1 - F.col("best.d") < merge).select("g", "embedding"), "g")
    edges = pairs.applyInPandas(_within, "j long, i long, d double")
    copies = live.filter("g < last").select(F.col("g").alias("j"), F.col("g").alias("i"), F.lit(0.0).alias("d"))
    edges = written(edges.unionByName(copies), "order-edges")

    inserted = filled.sparkSession.createDataFrame([], "i long, since long")
    for _ in range(ROUNDS):
        pending = waiting.groupBy(F.col("g").alias("i")).agg(F.min("seq").alias("pending"))
        judged = _offered(waiting, edges, pending.join(inserted, "i", "full"))
        judged = written(judged.withColumn("ready", F.coalesce(F.col("best") < F.col("rival"), F.lit(True))).drop("rival"), "order-judged")
        s = 1 - F.col("best.d")
        result = F.when(s < reject, "Reject").when(s >= merge, "Merge").otherwise("Insert")
        done = judged.filter("ready").select("seq", "g", F.col("best.o").alias("ord"), s.alias("similarity"), result.alias("result"))
        out = out.unionByName(done.drop("g"))
        waiting = judged.filter("not ready").drop("ready")
        inserted = written(inserted.unionByName(done.filter("result = 'Insert'").select(F.col("g").alias("i"), F.col("seq").alias("since"))).groupBy("i").agg(F.min("since").alias("since")), "order-inserted")
        if waiting.isEmpty():
            return out

    waiting = written(_offered(waiting, edges, inserted.withColumn("pending", F.lit(None).cast("long"))).drop("rival"), "order-waiting")
    held = waiting.select("g").distinct()
    edges = written(edges.join(held.withColumnRenamed("g", "i"), "i", "left_semi").join(held.withColumnRenamed("g", "j"), "j", "left_semi"), "order-rest")
    roots = components(edges.select(F.col("i").alias("a"), F.col("j").alias("b"))).withColumnRenamed("node", "g")
    rest = waiting.join(roots, "g", "left").join(edges.select(F.col("j").alias("g"), "i", F.col("d").alias("e")), "g", "left")
    rest = rest.select(F.coalesce("root", "g").alias("root"), "seq", "g", "best.d", "best.o", "i", "e")
    rest = rest.repartition("root").sortWithinPartitions("root", "seq", "e", "i")
    return out.unionByName(rest.mapInPandas(_one_after_the_other(reject, merge), _DECIDED))


def _similarity(a: str, b: str) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return 1 - F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def _nearest_sibling(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Squared distance of each concept of left to the nearest sibling in right but its best node."""
    if not len(left) or not len(right):
        return pd.DataFrame({"concept_id": left["concept_id"][:0], "d": np.zeros(0)})
    row, place, d = vectors.nearest_rows(vectors.matrix(left["embedding"]), vectors.matrix(right["embedding"]), np.arange(len(right)), 2)
    other = right["node_id"].to_numpy()[place] != left["node_id"].to_numpy()[row]
    return pd.DataFrame({"concept_id": left["concept_id"].to_numpy()[row[other]], "d": d[other]})


def compare_placement(inserted: DataFrame, nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """inserted: concept_id, node_id (best node), embedding; nodes: node_id, parent_id,
    embedding. Adds sim_parent, sim_siblings (largest; the best node itself is none) and
    placement: parent or sibling where that side reaches least and exceeds the other, else child.
    Concepts and siblings of one parent meet as matrices; a wide parent is cut into blocks."""
    n = nodes.select("node_id", "parent_id")
    c = inserted.join(n, "node_id", "left")
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("embedding").alias("p"))
    c = c.join(parents, "parent_id", "left").withColumn("sim_parent", _similarity("embedding", "p")).drop("p")
    blocks = lambda rows, name: rows.groupBy("parent_id").agg(F.ceil(F.count("*") / vectors.BLOCK_ROWS).cast("int").alias(name))
    left = c.filter("parent_id is not null").select("concept_id", "node_id", "parent_id", "embedding")
    right = nodes.filter("parent_id is not null").select("node_id", "parent_id", "embedding")
    counts = blocks(left, "lefts").join(blocks(right, "rights"), "parent_id")
    cut = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(counts, "parent_id").withColumn("lb", cut("concept_id", "lefts")).withColumn("rb", every("rights"))
    right = right.join(counts, "parent_id").withColumn("rb", cut("node_id", "rights")).withColumn("lb", every("lefts"))
    # both sides may come from one table, so all columns of the match are named anew
    left = left.select(*[F.col(k).alias(k) for k in ("concept_id", "node_id", "embedding")], *[F.col(k).alias(f"l_{k}") for k in ("parent_id", "lb", "rb")])
    right = right.select(*[F.col(k).alias(k) for k in ("node_id", "embedding")], *[F.col(k).alias(f"r_{k}") for k in ("parent_id", "lb", "rb")])
    schema = f"concept_id {inserted.schema['concept_id'].dataType.simpleString()}, d double"
    near = left.groupBy("l_parent_id", "l_lb", "l_rb").cogroup(right.groupBy("r_parent_id", "r_lb", "r_rb")).applyInPandas(_nearest_sibling, schema)
    near = near.groupBy("concept_id").agg((1 - F.min("d")).alias("sim_siblings"))
    p, s = F.coalesce("sim_parent", F.lit(float("-inf"))), F.coalesce("sim_siblings", F.lit(float("-inf")))
    placement = F.when((p >= least) & (p > s), "parent").when((s >= least) & (s > p), "sibling").otherwise("child")
    return c.join(near, "concept_id", "left").withColumn("placement", placement)


def context_definitions(prompts: pd.Series) -> pd.Series:
    """The offline default: the neighbours' names as a sentence. A prompt is JSON with parent and
    children as taxonomy.neighbourhood gives them, and siblings where asked for."""
    def one(prompt):
        around = json.loads(prompt)
        kind = f"A kind of {around['parent']['name']}" if around.get("parent") else "A top-level concept"
        names = [c.get("name") for c in around["children"]]
        return kind + (f" that covers {', '.join(n or '' for n in names)}." if names else ".")

    return prompts.map(one)


def fill_definitions(nodes: DataFrame, generator: calls.Model = context_definitions, name: str = "context", store: str | None = None, siblings: bool = False, clients: int = 8) -> DataFrame:
    """nodes (with `Source name`) with empty definitions generated from each node's name and
    neighbours as they are in the given table; the source tells so. Only neighbours of these
    nodes are read, siblings only on demand. generator gets JSON prompts; its answers are kept in
    store under name, so equal prompts are asked once and a job run again asks the rest."""
    missing = F.coalesce("definition", F.lit("")) == ""
    around = taxonomy.neighbourhood(nodes, nodes.filter(missing).select("node_id"), siblings).join(nodes.filter(missing).select("node_id", "name"), "node_id")
    what = ["name", "parent", "children", *(["siblings"] if siblings else [])]
    asked = around.select("node_id", F.to_json(F.struct(*what)).alias("prompt"))
    store = store or shared_path(nodes.sparkSession, "definitions")
    made = calls.answered(asked, "prompt", generator, store, name, clients=clients).select("node_id", F.col("answer").alias("made"))
    source = F.ltrim(F.concat(F.coalesce("Source name", F.lit("")), F.lit(" (LLM-generated definition)")))
    out = nodes.join(made, "node_id", "left")
    out = out.withColumn("Source name", F.when(F.col("made").isNotNull(), source).otherwise(F.col("Source name")))
    return out.withColumn("definition", F.coalesce("made", "definition")).drop("made")


# The columns of the sheet in their order.
SHEET = (
    "ID", "Term", "Type", "Source name", "Record number", "Preferred name", "Also know as/Alternative", "Term related to", "Definition",
    "Abbreviation", "Parent name/Broader", "Child name/Narrower", "Comments", "Status", "Associated Standards", "Alternative Names", "Alternative Definitions",
)


def export_rows(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """The 17 columns of the sheet and path, whose order is the preorder. Columns that nodes
    lack are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")
    parents = nodes.select(F.col("node_id").alias("p_id"), F.col("name").alias("p_name"))
    rows = nodes.join(order.select("node_id", "path"), "node_id").join(taxonomy.children_names(nodes), "node_id", "left")
    rows = rows.join(parents, F.col("parent_id") == F.col("p_id"), "left")
    made = {
        "ID": text("node_id"),
        "Term": text("name"),
        "Definition": text("definition"),
        "Parent name/Broader": text("p_name"),
        "Child name/Narrower": text("children"),
        "Status": F.when(text("status") == "", "NotFound").otherwise(text("status")),
        "Associated Standards": listed("standards"),
        "Alternative Names": listed("alt_names"),
        "Alternative Definitions": listed("alt_definitions"),
    }
    held = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in nodes.columns}
    return rows.select("path", *[made.get(c, held.get(c, F.lit(""))).alias(c) for c in SHEET])


def changed_nodes(nodes: DataFrame, concepts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Only the nodes that apply_decisions adds or changes. Of the hierarchy, the best nodes and
    their children are read."""
    made = decisions.select("seq", F.col("ord").alias("best"), "result").filter("result <> 'Reject'")
    best = nodes.join(made.select(F.col("best").alias("ord")).distinct(), "ord", "left_semi")
    family = best.select(F.col("node_id").alias("parent_id"))
    near = best.unionByName(nodes.join(family, "parent_id", "left_semi").join(best.select("node_id"), "node_id", "left_anti").select(best.columns))
    after = apply_decisions(near, concepts, decisions, nodes.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top")))
    merged = nodes.join(made.filter("result = 'Merge'").select(F.col("best").alias("ord")).distinct(), "ord", "left_semi").select("node_id")
    new = concepts.join(made.filter("result = 'Insert'"), "seq", "left_semi").select(F.col("concept_id").alias("node_id"))
    return after.join(merged.unionByName(new), "node_id", "left_semi")


def apply_decisions(nodes: DataFrame, concepts: DataFrame, decisions: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """nodes (with ord) after the decisions of decide_in_order: inserted concepts as last
    children of their best nodes, then merged ones added to theirs. Other columns of nodes stay,
    empty for new nodes but for `Source name`. top: the largest ord, if nodes are not all there are."""
    made = concepts.join(decisions.select("seq", F.col("ord").alias("best"), "result"), "seq")
    ids = nodes.select("ord", "node_id").unionByName(concepts.select((F.col("seq") + AFTER_NODES).alias("ord"), F.col("concept_id").alias("node_id")))
    made = made.join(ids, made.best == ids.ord).drop("ord")
    made = made.withColumn("concept_seq", F.col("seq"))
    grown = taxonomy.insert_children(nodes.drop("ord", "embedding"), made.filter("result = 'Insert'"))
    grown = taxonomy.merge_concepts(grown, made.filter("result = 'Merge'"))
    held = nodes.select("node_id", "ord", "embedding")
    # a new node follows all earlier ones, in concept order
    fresh = made.filter("result = 'Insert'").select(F.col("concept_id").alias("node_id"), "seq", "embedding")
    top = nodes.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top")) if top is None else top
    fresh = fresh.crossJoin(F.broadcast(top)).select("node_id", (F.col("top") + 1 + F.col("seq")).alias("ord"), "embedding")
    return grown.join(held.unionByName(fresh), "node_id")


def insert_snapshot(nodes: DataFrame, concepts: DataFrame, reject: float = taxonomy.REJECT, merge: float = taxonomy.MERGE) -> tuple[DataFrame, DataFrame]:
    """All concepts against one snapshot: decisions (the concepts' columns, node, similarity,
    result, best_matching_node) and the nodes after them, without vectors. nodes: with ord and
    embedding; concepts: concept_id, seq, name, definition, filename, page_number, embedding."""
    queries = concepts.filter("embedding is not null").select(F.col("seq").alias("query_id"), "embedding")
    best = vectors.nearest_nodes(queries, nodes.select(F.col("ord").alias("node_id"), "embedding"))
    best = best.select(F.col("query_id").alias("seq"), F.col("node_id").alias("ord"), (1 - F.col("distance")).alias("similarity"))
    scored = concepts.join(best, "seq", "left").join(nodes.select("ord", "node_id", F.col("name").alias("node")), "ord", "left").drop("ord")
    decided = written(taxonomy.decide(scored.withColumn("concept_seq", F.col("seq")), reject, merge), "snapshot")
    grown = taxonomy.insert_children(nodes.drop("ord", "embedding"), decided.filter("result = 'Insert'"))
    return decided, taxonomy.merge_concepts(grown, decided.filter("result = 'Merge'"))
