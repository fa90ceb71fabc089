"""Placement in the hierarchy against plain-Python definitions."""

import random

import pytest
from loomspark.operators import placement, taxonomy
from loomspark.streaming import insertion

CONCEPT = "concept_id string, seq long, name string, definition string, filename string, page_number int, embedding array<float>"
NODE = "node_id string, ord long, parent_id string, child_ord int, name string, definition string, status string, standards array<string>, alt_names array<string>, alt_definitions array<string>, embedding array<float>"


def one_by_one(concepts, nodes, reject, merge):
    stored, out = list(nodes), {}
    for seq, definition, v in concepts:
        if not definition:
            out[seq] = (None, "Reject")
            continue
        d, o = min((sum((a - b) ** 2 for a, b in zip(v, t, strict=True)), k) for k, t in stored)
        result = "Reject" if 1 - d < reject else "Merge" if 1 - d >= merge else "Insert"
        out[seq] = (o, result)
        if result == "Insert":
            stored.append((placement.AFTER_NODES + seq, v))
    return out


def sample(n, seed):
    rng = random.Random(seed)
    v = lambda: [rng.randint(-3, 3) / 4 for _ in range(3)]
    return [(i, "" if i % 17 == 5 else "d", v()) for i in range(n)], [(i, v()) for i in range(3)]


def test_ordered_decisions_equal_loop(spark):
    concepts, nodes = sample(90, 4)
    c = spark.createDataFrame([(f"c{i}", i, "n", d, "f", 1, v) for i, d, v in concepts], CONCEPT)
    n = spark.createDataFrame(nodes, "ord long, embedding array<float>")
    got = {r["seq"]: (r["ord"], r["result"]) for r in placement.decide_in_order(c, n, 0.5, 0.9).collect()}
    want = one_by_one(concepts, nodes, 0.5, 0.9)
    assert got == want and any(o and o >= placement.AFTER_NODES for o, _ in want.values())
    assert placement.decide_in_order(c.limit(0), n).count() == 0


def worlds(n_worlds, seed):
    """Many small cases in one table: worlds so far apart that none sees another."""
    rng = random.Random(seed)
    concepts, nodes = [], []
    for w in range(n_worlds):
        v = lambda: [float(w * 1000), *[rng.randint(-3, 3) / 4 for _ in range(2)]]  # noqa: B023, E731
        nodes += [(3 * w + k, v()) for k in range(rng.randint(1, 3))]
        concepts += [(w, v()) for _ in range(rng.randint(1, 14))]
    rng.shuffle(concepts)
    return [(i, w, v) for i, (w, v) in enumerate(concepts)], nodes


@pytest.mark.parametrize("rounds", [5, 0])
def test_thousand_cases_equal_loop(spark, monkeypatch, rounds):
    monkeypatch.setattr(placement, "ROUNDS", rounds)
    concepts, nodes = worlds(1000, 7)
    c = spark.createDataFrame([(f"c{i}", i, "n", "d", "f", 1, v) for i, _, v in concepts], CONCEPT)
    n = spark.createDataFrame(nodes, "ord long, embedding array<float>")
    got = {r["seq"]: (r["ord"], r["result"]) for r in placement.decide_in_order(c, n, 0.3, 0.9).collect()}
    want = {}
    for w in range(1000):
        want |= one_by_one([(i, "d", v) for i, x, v in concepts if x == w], [(o, v) for o, v in nodes if o // 3 == w], 0.3, 0.9)
    assert got == want
    assert sum(o >= placement.AFTER_NODES for o, _ in want.values()) > 1000


def test_no_nodes_reject_all(spark):
    concepts, nodes = sample(9, 4)
    c = spark.createDataFrame([(f"c{i}", i, "n", d, "f", 1, v) for i, d, v in concepts], CONCEPT)
    n = spark.createDataFrame(nodes, "ord long, embedding array<float>").limit(0)
    assert {(r["ord"], r["result"]) for r in placement.decide_in_order(c, n).collect()} == {(None, "Reject")}


def test_stream_equals_batches_in_order(spark, tmp_path):
    concepts, nodes = sample(12, 9)
    root = str(tmp_path / "root")
    insertion.start_hierarchy(spark.createDataFrame([(f"n{k}", k, "n0" if k else None, k, f"n{k}", "d", "Original", [], [], [], v) for k, v in nodes], NODE), root)
    src = str(tmp_path / "in")
    spark.createDataFrame([(f"c{i}", i, "n", d, "f", 1, v) for i, d, v in concepts], CONCEPT).write.parquet(src)
    insertion.insert_stream(spark.readStream.schema(CONCEPT).parquet(src), root, 0.5, 0.9).awaitTermination(120)
    want = one_by_one(concepts, nodes, 0.5, 0.9)
    after = insertion.version(spark, root, 0)
    n_new = sum(r == "Insert" for _, r in want.values())
    assert after.count() == len(nodes) + n_new
    assert after.filter("status = 'Introduced' or size(alt_names) > 0").count() >= n_new
    assert {r["seq"]: r["result"] for r in spark.read.parquet(f"{root}/decisions/b0").collect()} == {k: r for k, (_, r) in want.items()}


@pytest.mark.parametrize("block", [3, 10_000])
def test_siblings_in_blocks_equal_loop(spark, monkeypatch, block):
    monkeypatch.setattr(placement.vectors, "BLOCK_ROWS", block)
    rng = random.Random(12)
    v = lambda: [rng.randint(-4, 4) / 4 for _ in range(3)]
    nodes = [("r", None, v())] + [(f"n{i}", rng.choice(["r", "r", "n0", "n1"]) if i > 1 else "r", v()) for i in range(40)]
    concepts = [(f"c{i}", rng.choice(nodes)[0], v()) for i in range(30)]
    n = spark.createDataFrame(nodes, "node_id string, parent_id string, embedding array<double>")
    c = spark.createDataFrame(concepts, "concept_id string, node_id string, embedding array<double>")
    up, at = {k: p for k, p, _ in nodes}, {k: x for k, _, x in nodes}
    sim = lambda a, b: 1 - sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    want = {}
    for k, best, x in concepts:
        p = sim(x, at[up[best]]) if up[best] else None
        s = max((sim(x, y) for m, q, y in nodes if q is not None and q == up[best] and m != best), default=None)
        a, b = (-9.0 if z is None else z for z in (p, s))
        want[k] = (p, s, "parent" if a >= 0.1 and a > b else "sibling" if b >= 0.1 and b > a else "child")
    got = {r["concept_id"]: (r["sim_parent"], r["sim_siblings"], r["placement"]) for r in placement.compare_placement(c, n, 0.1).collect()}
    assert got == want and {w[2] for w in want.values()} >= {"sibling", "child"}


def test_placement_and_export(spark):
    rows = [("r", None, 0, "root", "top", [0.0, 0.0]), ("a", "r", 0, "A", "", [1.0, 0.0]), ("b", "r", 1, "B", None, [0.0, 1.0])]
    n = spark.createDataFrame(rows, "node_id string, parent_id string, child_ord int, name string, definition string, embedding array<double>")
    c = spark.createDataFrame([("x", "a", [0.1, 0.1]), ("y", "a", [0.1, 0.9]), ("z", "a", [5.0, 5.0]), ("w", "r", [0.0, 0.0])], "concept_id string, node_id string, embedding array<double>")
    got = {r["concept_id"]: r["placement"] for r in placement.compare_placement(c, n).collect()}
    assert got == {"x": "parent", "y": "sibling", "z": "child", "w": "child"}
    filled = {r["node_id"]: (r["definition"], r["Source name"]) for r in placement.fill_definitions(n.selectExpr("*", "case when node_id = 'a' then 'S' end as `Source name`")).collect()}
    assert filled == {"r": ("top", None), "a": ("A kind of root.", "S (LLM-generated definition)"), "b": ("A kind of root.", "(LLM-generated definition)")}
    wide = n.selectExpr("*", "'' as status", "array('s', 't') as standards", "cast(null as array<string>) as alt_names", "array('q') as alt_definitions", "'note' as Comments")
    sheet = placement.export_rows(wide, taxonomy.preorder(wide)).orderBy("path")
    assert sheet.columns == ["path", *placement.SHEET]
    first = sheet.first()
    assert (first["Term"], first["Child name/Narrower"], first["Status"], first["Associated Standards"], first["Comments"], first["Type"]) == ("root", "A; B", "NotFound", "s; t", "note", "")
