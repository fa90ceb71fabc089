"""Nearest nodes through a written index of cells, exact by the triangle inequality.

Nodes lie in the cell of their nearest centre and, inside it, in bands of distance to the centre.
A band's nodes are no nearer to a query than the query's distance to the centre lies outside the
band, so bands beyond a query's k-th distance so far are not compared with it. Where bands exclude
nothing, a search is all pairs in blocks: what is asked for are packs of bands, about as large as a
block, so a query is sent to as many tasks as there are blocks of nodes, not bands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.frames import written
from loomspark.operators import vectors

#: Centres are fitted on the SAMPLE nodes of smallest hash; cells, at most, and bands of a cell.
SAMPLE, MOST_CELLS, BANDS, FIT_ROUNDS = 8192, 1024, 4, 8
#: Nodes a query sees before its first bound.
FIRST_ROWS = 64
#: Rows that one batch of what is asked holds.
ASKED_ROWS = 8192


@dataclass
class Index:
    """The files of an index: rows (the nodes with cell, band, part), by cell, and bands (cell,
    band, rows, parts, low, high, centre; at most MOST_CELLS * BANDS rows)."""

    spark: SparkSession
    path: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def bands(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bands")


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(d, 0))


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and distance to the nearest centre of every row."""
    cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
    for lo in range(0, len(x), vectors.SLICE_ROWS):
        d = _distances(x[lo : lo + vectors.SLICE_ROWS], centres)
        cell[lo : lo + len(d)], far[lo : lo + len(d)] = d.argmin(1), d.min(1)
    return cell, far


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:cells]]
    for _ in range(FIT_ROUNDS):
        own = _nearest_centre(sample, centres)[0]
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def build_index(nodes: DataFrame, path: str) -> Index:
    """nodes: node_id (long), embedding, and what else a search may filter by or return. Nodes
    without a vector are left out."""
    spark = nodes.sparkSession
    nodes = nodes.filter("embedding is not null")
    n = nodes.count()
    sample = nodes.select("node_id", "embedding").orderBy(F.xxhash64("node_id"), "node_id").limit(SAMPLE).toPandas()
    centres = _centres(vectors.matrix(sample["embedding"]), min(MOST_CELLS, max(1, int(n**0.5)))) if n else np.zeros((0, 0))

    def place(batches):
        for rows in batches:
            cell, far = _nearest_centre(vectors.matrix(rows["embedding"]) if len(rows) else np.zeros((0, 1)), centres)
            yield rows.assign(cell=cell, to_centre=far)

    schema = nodes.schema.simpleString()[len("struct<") : -1] + ",cell:int,to_centre:double"
    placed = written(nodes.mapInPandas(place, schema), "index-placed")
    share = [i / BANDS for i in range(1, BANDS)]
    edges = placed.groupBy("cell").agg(F.percentile_approx("to_centre", share, 1000).alias("edges"))
    band = F.size(F.filter("edges", lambda e: e < F.col("to_centre")))
    placed = placed.join(F.broadcast(edges), "cell").withColumn("band", band).drop("edges")
    bands = placed.groupBy("cell", "band").agg(F.count("*").alias("rows"), F.min("to_centre").alias("low"), F.max("to_centre").alias("high"))
    bands = bands.withColumn("parts", F.ceil(F.col("rows") / vectors.BLOCK_ROWS).cast("int"))
    centre = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    bands.join(F.broadcast(centre), "cell").coalesce(1).write.parquet(f"{path}/bands")
    index = Index(spark, path)
    placed = placed.join(F.broadcast(index.bands.select("cell", "band", "parts")), ["cell", "band"])
    part = F.pmod(F.xxhash64("node_id"), F.col("parts")).cast("int")
    placed.withColumn("part", part).drop("parts", "to_centre").repartition("cell", "band", "part").write.partitionBy("cell").parquet(f"{path}/rows")
    return index


class _Bands:
    """All bands' summaries, as arrays, and the packs they are asked for in: bands in order, up to
    BLOCK_ROWS rows together; a larger band's parts are packs of their own."""

    def __init__(self, bands: pd.DataFrame):
        bands = bands.sort_values(["cell", "band"])
        self.cell, self.band, self.rows, self.parts, self.low, self.high = (bands[c].to_numpy() for c in ("cell", "band", "rows", "parts", "low", "high"))
        first = np.unique(self.cell, return_index=True)[1]
        self.centres = vectors.matrix(bands["centre"].iloc[first])
        self.at = np.searchsorted(self.cell[first], self.cell)
        self.pack, self.packs, held = np.zeros(len(bands), np.int64), 0, 0
        for i, (rows, parts) in enumerate(zip(self.rows.tolist(), self.parts.tolist(), strict=True)):
            if parts > 1 or not held or held + rows > vectors.BLOCK_ROWS:
                self.pack[i], held = self.packs, 0 if parts > 1 else rows
                self.packs += parts
            else:
                self.pack[i], held = self.packs - 1, held + rows

    def lower(self, x: np.ndarray, some: slice | np.ndarray = slice(None)) -> np.ndarray:
        """At least so far are the nodes of each band (of some), less some rounding."""
        centres, at = np.unique(self.at[some], return_inverse=True)
        d = _distances(x, self.centres[centres])[:, at]
        return np.maximum(0, np.maximum(d - self.high[some], self.low[some] - d) - 1e-6 * (1 + d))

    def first(self, lower: np.ndarray) -> np.ndarray:
        """How far the nearest bands up to FIRST_ROWS nodes are."""
        order = np.argsort(lower, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        last = np.maximum((before < FIRST_ROWS).sum(1) - 1, 0)
        return np.take_along_axis(lower, order, 1)[np.arange(len(lower)), last] if lower.size else np.zeros(len(lower))

    def packs_of(self, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and pack of all packs that hold a needed band."""
        asked = np.zeros((len(need), self.packs), bool)
        packs, start = np.unique(self.pack, return_index=True)
        asked[:, packs] = np.logical_or.reduceat(need, start, axis=1)
        for i in np.flatnonzero(self.parts > 1):
            asked[:, self.pack[i] : self.pack[i] + self.parts[i]] |= need[:, i : i + 1]
        return np.nonzero(asked)

    def table(self) -> pd.DataFrame:
        return pd.DataFrame({"cell": self.cell, "band": self.band, "pack": self.pack, "at": np.arange(len(self.pack))})


_BOUNDED = "query_id long, embedding array<double>, bound double"


def _slices(q: pd.DataFrame):
    """The batch in slices of at most SLICE_ROWS queries, with their vectors."""
    for lo in range(0, len(q), vectors.SLICE_ROWS):
        part = q.iloc[lo : lo + vectors.SLICE_ROWS]
        yield part, vectors.matrix(part["embedding"])


def _first_bounds(bands: _Bands):
    """The bound within which a query's first bands lie, less some rounding."""

    def run(batches):
        for q in batches:
            for part, x in _slices(q):
                yield part.assign(bound=bands.first(bands.lower(x)) * (1 + 1e-9) + 1e-9)

    return run


def _ask(bands: _Bands):
    """The packs that hold bands within a query's bound."""

    def run(batches):
        for q in batches:
            for part, x in _slices(q):
                i, pack = bands.packs_of(bands.lower(x) <= part["bound"].to_numpy()[:, None])
                for lo in range(0, len(i), ASKED_ROWS):
                    some = part.iloc[i[lo : lo + ASKED_ROWS]]
                    yield some.assign(pack=pack[lo : lo + ASKED_ROWS])

    return run


def _rows_within(bands: _Bands):
    """How many rows the bands within a query's bound hold."""

    def run(batches):
        for q in batches:
            for part, x in _slices(q):
                need = bands.lower(x) <= part["bound"].to_numpy()[:, None]
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "rows": need @ bands.rows.astype(np.int64)})

    return run


def _top(row: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, d, row))
    row, ids, d = row[order], ids[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], d[keep]


def _meet(bands: _Bands, top_k: int):
    """The top_k nodes of one block of a pack for each of a block of queries, as a cogrouped
    function. Bands beyond a query's bound are left out, unless most are needed anyway."""

    def run(q: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(nodes):
            nodes = nodes.sort_values("at", kind="stable")
            t, ids = vectors.matrix(nodes["embedding"]), nodes["node_id"].to_numpy()
            some, start = np.unique(nodes["at"].to_numpy(), return_index=True)
            end = np.append(start[1:], len(t))
            for part, x in _slices(q):
                need = bands.lower(x, some) <= part["bound"].to_numpy()[:, None]
                if need.mean() > 0.5:
                    got = vectors.nearest_rows(x, t, ids, top_k)
                else:
                    got = [(np.zeros(0, np.int64), ids[:0], np.zeros(0))]
                    for j in np.flatnonzero(need.any(0)):
                        who = np.flatnonzero(need[:, j])
                        row, i, d = vectors.nearest_rows(x[who], t[start[j] : end[j]], ids[start[j] : end[j]], top_k)
                        got.append((who[row], i, d))
                    got = _top(*(np.concatenate(c) for c in zip(*got, strict=True)), top_k)
                found.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[got[0]], "node_id": got[1], "distance": got[2]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": np.zeros(0, np.int64), "node_id": np.zeros(0, np.int64), "distance": np.zeros(0)})

    return run


def _compare(bounded: DataFrame, rows: DataFrame, bands: _Bands, top_k: int, blocks: int) -> DataFrame:
    """The top_k rows of every pack for the queries whose bound reaches into it: packs meet the
    queries in blocks of both."""
    asked = bounded.mapInPandas(_ask(bands), f"{_BOUNDED}, pack long")
    a = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    packs = rows.sparkSession.createDataFrame(bands.table(), "cell int, band int, pack long, at long")
    b = rows.join(F.broadcast(packs), ["cell", "band"]).select((F.col("pack") + F.col("part")).alias("pack"), "at", "node_id", "embedding")
    b = b.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return a.groupBy("pack", "qb").cogroup(b.groupBy("pack", "qb")).applyInPandas(_meet(bands, top_k), "query_id long, node_id long, distance double")


def _best(found: DataFrame, top_k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "node_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def _search(queries: DataFrame, index: Index, top_k: int, where: Column | None) -> tuple[DataFrame, DataFrame]:
    """The nearest rows, and for every query how many rows it is compared with."""
    queries = written(queries.filter("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "index-queries")
    summary = index.bands.toPandas()
    if summary.empty:
        none = queries.select("query_id", F.lit(0).cast("long").alias("rows")).limit(0)
        return queries.select("query_id", F.lit(0).cast("long").alias("node_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0), none
    bands, blocks = _Bands(summary), vectors.blocks_of(queries.count())
    rows = index.rows if where is None else index.rows.filter(where)
    near = written(queries.mapInPandas(_first_bounds(bands), _BOUNDED), "index-near")
    found = _best(_compare(near, rows, bands, top_k, blocks), top_k)
    kth = found.filter(F.col("rank") == top_k).select("query_id", F.sqrt("distance").alias("bound"))
    bounded = queries.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    # what is within the bound holds the first bands' nodes too, as far as they are near enough
    bounded = written(bounded.select("query_id", "embedding", "bound"), "index-far")
    return _best(_compare(bounded, rows, bands, top_k, blocks), top_k), bounded.mapInPandas(_rows_within(bands), "query_id long, rows long")


def nearest_in_index(queries: DataFrame, index: Index, top_k: int = 1, where: Column | None = None, metric: str = "squared") -> DataFrame:
    """As vectors.nearest_nodes, against an index: query_id, node_id, distance, rank; where
    chooses among the columns the nodes were indexed with."""
    if metric not in ("squared", "l2"):
        raise ValueError(f"unknown metric {metric}")
    best = _search(queries, index, top_k, where)[0]
    return best.withColumn("distance", F.sqrt("distance")) if metric == "l2" else best


def pairs_compared(queries: DataFrame, index: Index, top_k: int = 1) -> float:
    """The fraction of all pairs of queries and nodes that lie within the queries' bounds."""
    asked = _search(queries, index, top_k, None)[1].agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    nodes = index.bands.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return asked / max(1, nodes * queries.filter("embedding is not null").count())
