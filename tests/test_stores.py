"""Tables of versions, kept answers, index maintenance, pointer doubling and the insertion log."""

import glob
import os
import random

import pandas as pd
import pytest
from loomspark.functions import graph
from loomspark.functions.frames import numbered, numbered_within
from loomspark.operators import calls, placement, taxonomy, vectors, versions
from loomspark.streaming import insertion
from pyspark.sql import functions as F


def test_versions_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    t = versions.VersionedTable(spark, path, buckets=16)
    base = spark.createDataFrame([(f"k{i}", i, "old", None) for i in range(200)], "id string, ord long, v string, created timestamp")
    assert t.create(base) == 0
    batch = spark.createDataFrame([("k3", 1, "a", None), ("k3", 5, "b", None), ("new", 2, "c", None), (None, 3, "d", None)], base.schema)
    files = lambda: {os.path.relpath(f, path) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}
    before = files()
    assert t.upsert(batch, "one", F.expr("timestamp'2021-05-01'")) == 1
    held = {f"{r['folder']}/bucket={r['bucket']}" for r in t.manifests().filter("v = 1").collect()}
    touched = {h for h in held if h.startswith("1-")}
    assert before < files() and 1 <= len(touched) <= 3 and len(held - touched) >= 13
    assert all(any(f.startswith(f"data/{h}/") for f in before) for h in held - touched)
    now = t.rows().orderBy("ord").collect()
    assert [(r["id"], r["v"]) for r in now[-3:]] == [("new", "c"), (None, "d"), ("k3", "b")] and [r["ord"] for r in now[-3:]] == [200, 201, 202]
    assert len(now) == 202 and now[-1]["created"].year == 2021 and now[0]["created"] is None
    after = files()
    assert t.upsert(batch, "one") == 1 and t.latest() == 1 and files() == after  # a replay
    assert t.rows(0).count() == 200 and {r["v"] for r in t.rows(0).collect()} == {"old"}
    assert t.upsert(batch.limit(0), "none") == 2 and t.rows().count() == 202
    empty = versions.VersionedTable(spark, str(tmp_path / "e"))
    empty.create(base.limit(0))
    assert empty.rows().count() == 0
    empty.upsert(batch, "first")
    assert {r["ord"] for r in empty.rows().collect()} == {0, 1, 2}


def test_answers_are_asked_once_and_survive_failures(spark, tmp_path):
    log, store, bad = str(tmp_path / "log"), str(tmp_path / "store"), str(tmp_path / "bad")
    open(bad, "w").close()

    def model(texts: pd.Series) -> pd.Series:
        if os.path.exists(bad) and "t13" in set(texts):
            raise RuntimeError("the model is away")
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return texts.map(lambda t: None if t == "t7" else t.upper())

    rows = spark.createDataFrame([(i, f"t{i % 20}" if i % 11 else None) for i in range(200)], "n int, text string")
    with pytest.raises(Exception, match="away"):
        calls.answered(rows, "text", model, store, "m", clients=1, slices=20).count()
    asked = open(log).read().split()
    assert asked and len(asked) == len(set(asked))
    os.remove(bad)
    got = calls.answered(rows, "text", model, store, "m", clients=1, slices=20).collect()
    assert len(got) == 200 and all(r["answer"] == (None if r["text"] in (None, "t7") else r["text"].upper()) for r in got)
    asked = open(log).read().split()
    assert sorted(asked) == sorted(f"t{i}" for i in range(20))  # nothing twice, the failure included
    calls.answered(rows, "text", model, store, "m", clients=1).count()
    assert open(log).read().split() == [*asked, "t7"]  # what had no answer is asked again
    calls.answered(rows.filter("text = 't1'"), "text", model, store, "other").count()
    assert open(log).read().split()[-1] == "t1"


def test_index_is_brought_in_step(spark, tmp_path):
    docs = [(f"n{i}", f"word{i % 4} text") for i in range(10)]
    n = spark.createDataFrame([*docs, ("null", None)], "node_id string, doc string")
    first = vectors.synchronised(n, spark.createDataFrame([], "node_id string, doc_hash string, embedding array<float>"), str(tmp_path / "s")).drop("what").cache()
    assert first.count() == 11 and first.filter("embedding is null").count() == 0
    log = str(tmp_path / "log")

    def counted(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return vectors.hashed_embedding(texts)

    changed = spark.createDataFrame([(k, "changed" if k in ("n1", "n2") else d) for k, d in docs[:8]] + [("x", "fresh")], "node_id string, doc string")
    out = {r["node_id"]: (r["what"], r["embedding"]) for r in vectors.synchronised(changed, first, str(tmp_path / "t"), counted, "c").collect()}
    assert {k for k, v in out.items() if v[0] == "kept"} == {"n0", "n3", "n4", "n5", "n6", "n7"} and out["x"][0] == "missing" and out["n1"][0] == "changed"
    assert sorted(open(log).read().split()) == ["changed", "fresh"]
    assert out["n1"][1] == out["n2"][1] and out["n1"][1] == vectors.hashed_embedding(pd.Series(["changed"]))[0]
    what = {(r["node_id"], r["what"]) for r in vectors.out_of_sync(changed, first).collect()}
    assert what == {("x", "missing"), ("n1", "changed"), ("n2", "changed"), ("n8", "extra"), ("n9", "extra"), ("null", "extra")}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    writes = []
    real = taxonomy.written
    monkeypatch.setattr(taxonomy, "written", lambda df, tag: writes.append(tag) or real(df, tag))
    n = 100_000
    chain = spark.range(n).select(F.col("id").cast("string").alias("node_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    out = taxonomy.ancestors(chain)
    row = out.agg(F.max("depth"), F.sum(F.col("depth").cast("long")), F.count_distinct("top"), F.sum(F.col("in_cycle").cast("int"))).first()
    assert tuple(row) == (n - 1, n * (n - 1) // 2, 1, 0) and len(writes) < 20


def test_preorder_of_deep_trees(spark):
    rng = random.Random(2)
    rows = [(0, None, 0)] + [(i, max(0, i - rng.randint(1, 3)), rng.randint(0, 10**6)) for i in range(1, 300)]
    n = spark.createDataFrame([(str(i), None if p is None else str(p), o) for i, p, o in rows], "node_id string, parent_id string, child_ord int")
    path = {}
    for i, p, o in rows:
        path[str(i)] = [*(path[str(p)] if p is not None else []), o]
    assert {r["node_id"]: r["path"] for r in taxonomy.preorder(n).collect()} == path


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(100)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_numbers_run_across_ranges(spark):
    rows = [(i * 7919 % 5000, i % 3 if i % 7 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "x int, g int").repartition(7)
    assert all(r["x"] == r["n"] for r in numbered(df, "x").collect())
    place = {}
    for x, g in sorted(rows):
        place[x] = place.setdefault("seen", {}).get(g, 0)
        place["seen"][g] = place[x] + 1
    assert all(r["n"] == place[r["x"]] for r in numbered_within(df, "g", "x").collect())


CONCEPT = "concept_id string, seq long, name string, definition string, filename string, page_number int, embedding array<float>"
NODE = "node_id string, ord long, parent_id string, child_ord int, name string, definition string, status string, standards array<string>, alt_names array<string>, alt_definitions array<string>, embedding array<float>"


def test_insertion_log(spark, tmp_path):
    compact = 2
    rng = random.Random(6)
    v = lambda: [rng.randint(-3, 3) / 4 for _ in range(3)]
    root = str(tmp_path / "root")
    nodes = spark.createDataFrame([(f"n{k}", k, f"n{k // 3}" if k else None, k, f"n{k}", "d", "Original", [], [], [], v()) for k in range(400)], NODE)
    insertion.start_hierarchy(nodes, root)
    want = nodes
    for k in range(3):
        batch = spark.createDataFrame([(f"c{k}-{i}", i, f"name {k} {i}", "d", "f", i, [x + 2.5 * (i % 2) for x in v()]) for i in range(8)], CONCEPT)
        for _ in range(1 + (k == 1)):  # the second batch comes twice
            insertion.insert_batch(batch, k, root, -3.0, 0.95, compact)
        decided = placement.decide_in_order(batch, want.select("ord", "embedding"), -3.0, 0.95)
        want = spark.createDataFrame(placement.apply_decisions(want, batch, decided).select(nodes.columns).collect(), NODE)
        rows = lambda df: sorted(map(str, df.select(nodes.columns).collect()))
        assert rows(insertion.version(spark, root, k, compact)) == rows(want)
        assert spark.read.parquet(f"{root}/deltas/b{k}").count() <= 8
    assert want.filter("status = 'Introduced'").count() > 3 and want.filter("status = 'Corroborated'").count() > 3
    assert len(glob.glob(f"{root}/nodes/v*")) == 2
