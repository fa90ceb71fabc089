"""The concept hierarchy as an adjacency table: node_id, parent_id, child_ord, name,
definition, status, standards, alt_names, alt_definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.frames import numbered_within, written
from loomspark.functions.text import stable_id, strip

REJECT, MERGE = 0.5, 0.65


#: Sheet columns that hold lists, and the columns of a node they become.
LISTS = {"Associated Standards": "standards", "Alternative Names": "alt_names", "Alternative Definitions": "alt_definitions"}


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Sheet rows (row_ord, ID, Term, ...): the last row's content at the first row's place (pos).
    An exported sheet is read back: its Status and its lists stay; else they are "Original" and
    empty."""
    name = strip("Term")
    out = rows.withColumn("name", name).groupBy("name").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), "row_ord").alias("r"), F.min("row_ord").alias("pos"))
    held = lambda c: F.col("r")[c] if c in rows.columns else F.lit(None).cast("string")
    node_id = F.when(F.coalesce(held("ID"), F.lit("")) != "", held("ID")).otherwise(stable_id("name"))
    status = F.when(F.coalesce(held("Status"), F.lit("")) != "", held("Status")).otherwise("Original")
    listed = lambda c: F.when(F.coalesce(held(c), F.lit("")) != "", F.split(held(c), "; ")).otherwise(F.array().cast("array<string>"))
    made = {"ID", "Term", "row_ord", "Definition", "Status", "name", *LISTS}
    other = [F.col("r")[c].alias(c) for c in rows.columns if c not in made]
    return out.select(node_id.alias("node_id"), "name", "pos", held("Definition").alias("definition"), status.alias("status"), *[listed(c).alias(v) for c, v in LISTS.items()], *other)


def resolve_parents(nodes: DataFrame, parent: str = "Parent name/Broader", preferred: str = "Preferred name") -> DataFrame:
    """Adds parent_id (by name, else by the first node with that preferred name) and orphan."""
    want = strip(F.coalesce(F.col(f"`{parent}`"), F.lit("")))
    n = nodes.withColumn("want", want)
    by_name = nodes.select(F.col("name").alias("want"), F.col("node_id").alias("p1"))
    other = nodes.select(strip(F.col(f"`{preferred}`")).alias("want"), "node_id", "pos").filter("want <> ''")
    other = other.groupBy("want").agg(F.min_by("node_id", "pos").alias("p2"))
    out = n.join(by_name, "want", "left").join(other, "want", "left").withColumn("parent_id", F.coalesce("p1", "p2"))
    return out.withColumn("orphan", (F.col("want") != "") & F.col("parent_id").isNull()).drop("p1", "p2", "want")


def grow(nodes: DataFrame) -> DataFrame:
    """Nodes of normalize_rows as a hierarchy: resolved parents, child_ord by place; the sheet's
    own parent and child columns go."""
    n = resolve_parents(nodes)
    order = F.row_number().over(W.partitionBy("parent_id").orderBy("pos")) - 1
    return n.withColumn("child_ord", order).drop("Parent name/Broader", "Child name/Narrower")


def ancestors(nodes: DataFrame) -> DataFrame:
    """node_id, depth, top and in_cycle, by pointer doubling: each round doubles the way that every
    node looks up, so there are about log2 of the depth of them. top is the root (or the node
    whose parent is unknown) above a node; nodes that never reach one have no depth, and those
    among them that meet themselves are in_cycle, others lie below one."""
    flat = nodes.select("node_id", "parent_id").dropDuplicates(["node_id"])
    known = flat.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    # at: the ancestor `steps` above, or the node itself once that is a top (done)
    at = flat.join(known, "parent_id", "left").select("node_id", F.coalesce(F.when(F.col("known"), F.col("parent_id")), F.col("node_id")).alias("at"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"), F.col("known").isNull().alias("done"))
    at = written(at, "ancestors")
    seen = None
    while True:
        open_ = at.filter("not done").agg(F.count("*"), F.count_distinct("at")).first()
        # no node got to a top, so none ever will; and no place was left, so all are on cycles
        if not open_[0] or open_ == seen:
            break
        seen = open_
        up = at.select(F.col("node_id").alias("at"), F.col("at").alias("up"), F.col("steps").alias("more"), F.col("done").alias("over"))
        at = at.join(up, "at").select("node_id", F.col("up").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("done") | F.col("over")).alias("done"))
        at = written(at, "ancestors")
    # every node of a cycle is where some node has got to
    cycle = at.filter("not done").select(F.col("at").alias("node_id"), F.lit(True).alias("met")).distinct()
    out = at.join(cycle, "node_id", "left")
    return out.select("node_id", F.when(F.col("done"), F.col("steps")).cast("int").alias("depth"), F.when(F.col("done"), F.col("at")).alias("top"), F.coalesce("met", F.lit(False)).alias("in_cycle"))


def preorder(nodes: DataFrame) -> DataFrame:
    """node_id, depth, path of child ordinals and is_last flags; order by path gives the
    preorder. Paths double in every round: a node's path below its ancestor is put behind the
    ancestor's own. Nodes without a path from a root stay out."""
    top = nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.max("child_ord").alias("top"))
    flat = nodes.join(top, "parent_id", "left")
    last = F.col("parent_id").isNull() | (F.col("child_ord") == F.col("top"))
    at = written(flat.select("node_id", F.col("parent_id").alias("at"), F.array("child_ord").alias("path"), F.array(last).alias("lasts")), "paths")
    rooted = nodes.filter("parent_id is null").select("node_id")
    out = written(at.join(rooted, "node_id", "left_semi").drop("at"), "paths")
    whole = out
    # nodes that never get to a root would go on for ever
    at = at.join(ancestors(nodes).filter("depth > 0").select("node_id", "top").join(rooted.withColumnRenamed("node_id", "top"), "top", "left_semi"), "node_id", "left_semi")
    at = written(at, "paths")
    while not at.isEmpty():
        up = whole.select(F.col("node_id").alias("at"), F.lit(None).cast(nodes.schema["node_id"].dataType).alias("up"), F.col("path").alias("p"), F.col("lasts").alias("l"))
        up = up.unionByName(at.select(F.col("node_id").alias("at"), F.col("at").alias("up"), F.col("path").alias("p"), F.col("lasts").alias("l")))
        at = written(at.join(up, "at").select("node_id", F.col("up").alias("at"), F.concat("p", "path").alias("path"), F.concat("l", "lasts").alias("lasts")), "paths")
        whole = written(whole.unionByName(at.filter("at is null").drop("at")), "paths")
        at = at.filter("at is not null")
    return whole.select("node_id", (F.size("path") - 1).alias("depth"), "path", "lasts")


def validate(nodes: DataFrame, strict: bool = False) -> DataFrame:
    """error, node_id: several roots, no root, unknown parents, nodes in cycles, and nodes that a
    cycle or an unknown parent above them cuts off. strict raises if there is any. An orphan
    (resolve_parents) is no root; its parent is unknown."""
    orphan = F.coalesce("orphan", F.lit(False)) if "orphan" in nodes.columns else F.lit(False)
    nodes = nodes.withColumn("parent_id", F.when(orphan, F.lit("")).otherwise(F.col("parent_id")))
    roots = nodes.filter("parent_id is null")
    count = roots.agg(F.count("*").alias("n"))
    many = roots.crossJoin(F.broadcast(count)).filter("n > 1").select(F.lit("several roots").alias("error"), "node_id")
    none = count.filter("n = 0").select(F.lit("no root").alias("error"), F.lit(None).cast("string").alias("node_id"))
    known = nodes.select(F.col("node_id").alias("parent_id"))
    lost = nodes.filter("parent_id is not null").join(known, "parent_id", "left_anti")
    found = written(ancestors(nodes), "validated")
    loops = found.filter("in_cycle").select(F.lit("in a cycle").alias("error"), "node_id")
    below = found.filter("depth > 0").join(lost.select(F.col("node_id").alias("top")), "top", "left_semi")
    cut = found.filter("depth is null and not in_cycle").select("node_id").unionByName(below.select("node_id"))
    errors = many.unionByName(none).unionByName(lost.select(F.lit("parent not found").alias("error"), "node_id")).unionByName(loops)
    errors = errors.unionByName(cut.select(F.lit("not reachable").alias("error"), "node_id"))
    if strict and (first := errors.orderBy("error", "node_id").first()) is not None:
        raise ValueError(f"{first['error']}: {first['node_id']}")
    return errors


def children_names(nodes: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("child_ord", "name")))
    out = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(rows.alias("c"))
    return out.select("node_id", F.array_join("c.name", "; ").alias("children"), F.size("c").alias("n_children"))


def render(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """path, line: one line a node with box prefixes."""
    inner = F.when(F.size("lasts") > 2, F.slice("lasts", 2, F.size("lasts") - 2)).otherwise(F.array().cast("array<boolean>"))
    bars = F.array_join(F.transform(inner, lambda x: F.when(x, "    ").otherwise("│   ")), "")
    tip = F.when(F.col("depth") == 0, "").when(F.element_at("lasts", -1), "└── ").otherwise("├── ")
    return order.join(nodes.select("node_id", "name"), "node_id").select("node_id", "path", F.concat(bars, tip, "name").alias("line"))


def neighbourhood(nodes: DataFrame, only: DataFrame | None = None, siblings: bool = True) -> DataFrame:
    """parent, siblings and children, as (name, definition), of every node or of those of only
    (node_id). Sibling lists repeat a parent's children for each child, so they can be left out."""
    item = F.struct("name", "definition")
    rows = F.array_sort(F.collect_list(F.struct("child_ord", "node_id", "name", "definition")))
    kids = lambda of: nodes.join(of, "parent_id", "left_semi").groupBy("parent_id").agg(rows.alias("kids"))
    plain = lambda a: F.transform(a, lambda x: F.struct(x["name"].alias("name"), x["definition"].alias("definition")))
    some = nodes if only is None else nodes.join(only.select("node_id"), "node_id", "left_semi")
    parents = nodes.select(F.col("node_id").alias("p_id"), item.alias("parent"))
    own = kids(some.select(F.col("node_id").alias("parent_id"))).select(F.col("parent_id").alias("o_id"), F.col("kids").alias("own"))
    out = some.join(parents, some.parent_id == parents.p_id, "left").join(own, some.node_id == own.o_id, "left")
    none = F.array().cast("array<struct<name:string,definition:string>>")
    found = ["node_id", "parent", F.coalesce(plain(F.col("own")), none).alias("children")]
    if siblings:
        out = out.join(kids(some.filter("parent_id is not null").select("parent_id")), "parent_id", "left")
        others = F.filter("kids", lambda x: x["node_id"] != F.col("node_id"))
        found.append(F.coalesce(plain(others), none).alias("siblings"))
    return out.select(*found)


def node_document() -> Column:
    return F.concat(F.coalesce("name", F.lit("")), F.lit(": "), F.coalesce("definition", F.lit("")))


def decide(scored: DataFrame, reject: float = REJECT, merge: float = MERGE) -> DataFrame:
    """Adds result to (name, definition, node, similarity) rows; incomplete concepts are
    rejected without a best node."""
    empty = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("definition", F.lit("")) == "")
    s = F.col("similarity")
    low = empty | s.isNull() | (s < reject)
    out = scored.withColumn("result", F.when(low, "Reject").when(s >= merge, "Merge").otherwise("Insert"))
    best = F.when(~empty & s.isNotNull(), F.struct(F.col("node").alias("name"), s.alias("similarity_score")))
    return out.withColumn("best_matching_node", best)


def merge_concepts(nodes: DataFrame, merged: DataFrame, salt: int = 16) -> DataFrame:
    """merged: node_id, concept_seq, name, definition, filename, page_number. Names,
    definitions and standards are appended in concept order; two levels keep a popular node's
    list from meeting in one partial step."""
    mark = F.concat(F.col("filename"), F.lit(" (p. "), F.col("page_number").cast("string"), F.lit(")"))
    row = F.struct("concept_seq", "name", "definition", mark.alias("mark"))
    part = merged.groupBy("node_id", F.pmod("concept_seq", F.lit(salt)).alias("salt")).agg(F.collect_list(row).alias("r"))
    full = part.groupBy("node_id").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("r"))
    out = nodes.join(full, "node_id", "left")
    add = lambda col, field: F.when(F.col("r").isNull(), F.col(col)).otherwise(F.concat(F.coalesce(col, F.array().cast("array<string>")), F.col(f"r.{field}")))
    return (
        out.withColumn("alt_names", add("alt_names", "name"))
        .withColumn("alt_definitions", add("alt_definitions", "definition"))
        .withColumn("standards", add("standards", "mark"))
        .withColumn("status", F.when(F.col("r").isNotNull(), "Corroborated").otherwise(F.col("status")))
        .drop("r")
    )


def _fresh(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node_id, parent_id, child_ord, name, definition, filename, page_number) as nodes
    with the columns of nodes, in their order."""
    mark = F.concat(F.col("filename"), F.lit(" (p. "), F.col("page_number").cast("string"), F.lit(")"))
    none = F.array().cast("array<string>")
    made = {"status": F.lit("Introduced"), "standards": F.array(mark), "alt_names": none, "alt_definitions": none, "Source name": F.col("filename")}
    held = ("node_id", "parent_id", "child_ord", "name", "definition")
    value = lambda f: F.col(f.name) if f.name in held else made.get(f.name, F.lit(None))
    return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in nodes.schema.fields])


def insert_children(nodes: DataFrame, inserted: DataFrame) -> DataFrame:
    """inserted: concept_id, node_id (best node), concept_seq, name, definition, filename,
    page_number. New nodes come last under their best node."""
    top = nodes.groupBy(F.col("parent_id").alias("t_parent")).agg(F.max("child_ord").alias("top")).filter("t_parent is not null")
    new = inserted.select(F.col("concept_id").alias("node_id"), F.col("node_id").alias("parent_id"), "concept_seq", "name", "definition", "filename", "page_number")
    new = numbered_within(new, "parent_id", "concept_seq", "node_id", name="r").join(top, F.col("parent_id") == F.col("t_parent"), "left")
    return nodes.unionByName(_fresh(new.withColumn("child_ord", F.coalesce("top", F.lit(-1)) + 1 + F.col("r")), nodes))


def insert_parents(nodes: DataFrame, inserted: DataFrame) -> DataFrame:
    """inserted: concept_id, node_id (best node), concept_seq, name, definition, filename,
    page_number. A new node takes the best node's place and comes last under its parent, the
    best node becomes its child. Several for one node apply in concept order: a later one sits
    directly above the node, so each lies under the one before it."""
    new = inserted.select("concept_id", "node_id", "concept_seq", "name", "definition", "filename", "page_number")
    by_node = W.partitionBy("node_id").orderBy("concept_seq")
    new = new.withColumn("above", F.lag("concept_id").over(by_node)).withColumn("later", F.lead("concept_id").over(by_node))
    moves = new.filter("later is null").select(F.col("node_id").alias("m_id"), F.col("concept_id").alias("m_parent"))
    place = nodes.select(F.col("node_id").alias("p_id"), F.col("parent_id").alias("old"))
    new = new.join(place, F.col("node_id") == F.col("p_id"))
    top = nodes.groupBy(F.col("parent_id").alias("t_parent")).agg(F.max("child_ord").alias("top"))
    outer = F.col("above").isNull()
    new = new.join(top, outer & F.col("old").eqNullSafe(F.col("t_parent")), "left")
    rank = F.row_number().over(W.partitionBy(outer, "old").orderBy("concept_seq"))
    child_ord = F.when(outer, F.coalesce("top", F.lit(-1)) + rank).otherwise(0)
    rows = new.select(F.col("concept_id").alias("node_id"), F.coalesce("above", "old").alias("parent_id"), child_ord.alias("child_ord"), "name", "definition", "filename", "page_number")
    old = nodes.join(moves, F.col("node_id") == F.col("m_id"), "left")
    moved = old.withColumn("child_ord", F.when(F.col("m_parent").isNotNull(), 0).otherwise(F.col("child_ord")).cast(nodes.schema["child_ord"].dataType))
    moved = moved.withColumn("parent_id", F.coalesce("m_parent", "parent_id")).select(*[F.col(f"`{c}`") for c in nodes.columns])
    return moved.unionByName(_fresh(rows, nodes))


def decision_summary(decisions: DataFrame, *keys: str) -> DataFrame:
    count = lambda r: F.count(F.when(F.col("result") == r, 1)).alias(f"n_{r.lower()}")
    return decisions.groupBy(*keys).agg(count("Reject"), count("Merge"), count("Insert"))
