"""Embeddings, index checks and nearest nodes."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.frames import written
from loomspark.operators import calls

#: Rows of one block of either side, and of the slices compared at once inside a task.
BLOCK_ROWS, SLICE_ROWS = 16384, 512


def hashed_embedding(texts: pd.Series, dim: int = 64) -> pd.Series:
    """Deterministic L2-normalised hashed word vector, the offline default."""
    out = []
    for t in texts.fillna(""):
        v = np.zeros(dim, np.float32)
        for w in t.lower().split():
            h = int(md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:12], 16)
            v[(h >> 1) % dim] += 1 if h & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return pd.Series(out, dtype=object)


def embed(docs: DataFrame, text: str, embedder: Callable[[pd.Series], pd.Series] = hashed_embedding) -> DataFrame:
    def run(texts: pd.Series) -> pd.Series:
        return embedder(texts)

    return docs.withColumn("embedding", F.pandas_udf(run, "array<float>")(text))


def embed_once(docs: DataFrame, text: str, store: str, embedder: Callable[[pd.Series], pd.Series] = hashed_embedding, name: str = "hashed") -> DataFrame:
    """As embed, through a store of vectors by content: equal texts are embedded once, also
    across jobs, and a job run again embeds what is missing. name tells embedders apart."""
    return calls.answered(docs, text, embedder, store, name, "array<float>").withColumnRenamed("answer", "embedding")


def out_of_sync(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """node_id and what: ids missing from the index, left over in it, or, where nodes have doc
    and the index doc_hash, changed."""
    a = nodes.select("node_id").join(index.select("node_id"), "node_id", "left_anti").withColumn("what", F.lit("missing"))
    b = index.select("node_id").join(nodes.select("node_id"), "node_id", "left_anti").withColumn("what", F.lit("extra"))
    out = a.unionByName(b)
    if "doc" in nodes.columns and "doc_hash" in index.columns:
        both = nodes.select("node_id", content_hash().alias("now")).join(index.select("node_id", "doc_hash"), "node_id")
        out = out.unionByName(both.filter("not now <=> doc_hash").select("node_id", F.lit("changed").alias("what")))
    return out


def content_hash(doc: str = "doc") -> Column:
    return F.sha2(F.coalesce(F.col(doc), F.lit("")), 256)


def synchronised(nodes: DataFrame, index: DataFrame, store: str, embedder: Callable[[pd.Series], pd.Series] = hashed_embedding, name: str = "hashed") -> DataFrame:
    """nodes: node_id (unique), doc. index: node_id, doc_hash, embedding. The index brought in step
    with the nodes: node_id, doc_hash, embedding and what (kept, missing or changed). Only missing
    and changed nodes are embedded, each text once; extra entries are left out."""
    now = nodes.select("node_id", "doc", content_hash().alias("doc_hash"))
    was = index.select("node_id", F.col("doc_hash").alias("was"), "embedding", F.lit(True).alias("held"))
    both = written(now.join(was, "node_id", "left"), "index-state")
    kept = F.col("held") & F.col("was").eqNullSafe(F.col("doc_hash"))
    stay = both.filter(kept).select("node_id", "doc_hash", "embedding", F.lit("kept").alias("what"))
    todo = both.filter(~F.coalesce(kept, F.lit(False))).select("node_id", "doc_hash", F.coalesce("doc", F.lit("")).alias("doc"), F.when(F.col("held"), "changed").otherwise("missing").alias("what"))
    made = embed_once(todo, "doc", store, embedder, name)
    return stay.unionByName(made.select("node_id", "doc_hash", "embedding", "what"))


def nearest_rows(x: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, id and squared distance of the k nearest rows of t, smaller ids on ties. The
    matrix product only preselects: everything within rounding of the k-th distance is computed
    exactly."""
    rows, out, distances = [], [], []
    norms = (t * t).sum(1)
    for lo in range(0, len(x) if len(t) else 0, SLICE_ROWS):
        part = x[lo : lo + SLICE_ROWS]
        own = (part * part).sum(1)
        d = own[:, None] + norms[None, :] - 2 * part @ t.T
        m = min(k, len(t))
        edge = np.partition(d, m - 1, axis=1)[:, m - 1]
        margin = 1e-9 * (own + norms.max() + 1)
        i, j = np.nonzero(d <= (edge + margin)[:, None])
        exact = ((part[i] - t[j]) ** 2).sum(1)
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)  # place of each row's first candidate
        keep = np.arange(len(i)) - first < k
        rows.append(i[keep] + lo)
        out.append(ids[j[keep]])
        distances.append(exact[keep])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(out), np.concatenate(distances)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def blocks_of(rows: int) -> int:
    """Number of blocks of at most about BLOCK_ROWS rows."""
    return max(1, -(-rows // BLOCK_ROWS))


def in_blocks(left: DataFrame, left_key: str, right: DataFrame, right_key: str):
    """Both sides cut into blocks by hash, as many as their rows ask for; every pair of blocks
    meets as one cogroup. Rows of a side are repeated for each block of the other."""
    n_left, n_right = blocks_of(left.count()), blocks_of(right.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("lb", F.pmod(F.xxhash64(left_key), F.lit(n_left))).withColumn("rb", every(n_right))
    b = right.withColumn("rb", F.pmod(F.xxhash64(right_key), F.lit(n_right)).cast("int")).withColumn("lb", every(n_left))
    return a.groupBy(F.col("lb").cast("int").alias("lb"), "rb").cogroup(b.groupBy("lb", "rb"))


def nearest_of(top_k: int):
    """The top_k nearest rows of one frame for each row of another, as a cogrouped function."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, ids, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(left) and len(right):
            row, ids, d = nearest_rows(matrix(left["embedding"]), matrix(right["embedding"]), right["node_id"].to_numpy(), top_k)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[row], "node_id": ids, "distance": d})

    return run


def nearest_nodes(queries: DataFrame, nodes: DataFrame, top_k: int = 1, where: Column | None = None, metric: str = "squared") -> DataFrame:
    """queries: query_id, embedding; nodes: node_id (longs), embedding, perhaps doc and columns
    for where, which chooses nodes before the ranking. query_id, node_id, distance, rank, and doc
    if nodes have it: the top_k nodes, smaller ids first on ties. metric: squared or l2."""
    if metric not in ("squared", "l2"):
        raise ValueError(f"unknown metric {metric}")
    nodes = nodes if where is None else nodes.filter(where)
    pairs = in_blocks(queries.select("query_id", "embedding"), "query_id", nodes.select("node_id", "embedding"), "node_id")
    part = pairs.applyInPandas(nearest_of(top_k), "query_id long, node_id long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "node_id"))
    best = part.withColumn("rank", rank).filter(F.col("rank") <= top_k)
    if metric == "l2":
        best = best.withColumn("distance", F.sqrt("distance"))
    return best.join(nodes.select("node_id", "doc"), "node_id") if "doc" in nodes.columns else best
