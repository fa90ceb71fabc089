"""The index of cells against all pairs."""

import random

import numpy as np
import pytest
from loomspark.operators import vector_index, vectors
from pyspark.sql import functions as F

NODE = "node_id long, embedding array<float>, kind int"


def clustered(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim)) * 10
    return [(i, [float(x) for x in np.round(centres[rng.integers(25)] + rng.normal(size=dim), 2)], i % 3) for i in range(n)]


def nearest(queries, nodes, k, allowed=lambda kind: True):
    out = {}
    x = np.array([np.array(v, np.float32) for _, v, kind in nodes if allowed(kind)], np.float64)
    ids = np.array([i for i, _, kind in nodes if allowed(kind)])
    for q, v, _ in queries:
        d = ((x - np.array(v, np.float32).astype(float)) ** 2).sum(1)
        out[q] = [int(ids[j]) for j in np.lexsort((ids, d))[:k]]
    return out


@pytest.mark.parametrize("block", [vectors.BLOCK_ROWS, 20])
def test_index_equals_all_pairs(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    nodes = clustered(700, 3)
    nodes += [(1000 + i, nodes[5][1], 1) for i in range(40)]  # ties beyond k
    queries = random.Random(1).sample(nodes, 30) + [(5000, [0.0] * 8, 0)]
    n = spark.createDataFrame([*nodes, (2000, None, 0)], NODE)
    q = spark.createDataFrame([*queries, (6000, None, 0)], NODE.replace("node_id", "query_id"))
    index = vector_index.build_index(n, str(tmp_path / "index"))
    for where, allowed in ((None, lambda k: True), ("kind", lambda k: k == 1)):
        rows = vector_index.nearest_in_index(q, index, 3, None if where is None else F.col("kind") == 1).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["node_id"])
        assert got == nearest(queries, nodes, 3, allowed)
    assert vector_index.pairs_compared(q, index, 3) < 0.2


def test_more_rows_than_nodes_and_no_nodes(spark, tmp_path):
    n = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)], NODE)
    q = n.withColumnRenamed("node_id", "query_id")
    index = vector_index.build_index(n, str(tmp_path / "a"))
    assert sorted((r["query_id"], r["node_id"], r["rank"]) for r in vector_index.nearest_in_index(q, index, 5).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2)]
    empty = vector_index.build_index(n.limit(0), str(tmp_path / "b"))
    assert vector_index.nearest_in_index(q, empty, 5).count() == 0
    assert vector_index.nearest_in_index(q.limit(0), index, 5).count() == 0


def test_queries_are_not_repeated_for_every_band(spark, monkeypatch, tmp_path):
    """Of vectors spread evenly no band is excluded; what a search writes and sends stays a row a
    query and block."""
    x = np.random.default_rng(5).normal(size=(2000, 32)).round(3)
    nodes = [(i, v, 0) for i, v in enumerate(x.tolist())]
    n = spark.createDataFrame(nodes, NODE)
    q = n.filter("node_id % 40 = 0").withColumnRenamed("node_id", "query_id")
    sizes, write = {}, vector_index.written

    def spy(df, tag):
        out = write(df, tag)
        sizes[tag] = out.count()
        return out

    index = vector_index.build_index(n, str(tmp_path / "index"))
    monkeypatch.setattr(vector_index, "written", spy)
    got = vector_index.nearest_in_index(q, index, 3).collect()
    assert len(got) == 150 and sizes["index-far"] <= 50
    assert vector_index.pairs_compared(q, index, 3) > 0.9
    want = nearest([(i, v, 0) for i, v, _ in nodes[::40]], nodes, 3)
    assert {(r["query_id"], r["rank"]): r["node_id"] for r in got} == {(k, i + 1): v for k, ids in want.items() for i, v in enumerate(ids)}
