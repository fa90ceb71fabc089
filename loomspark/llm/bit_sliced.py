"""Exact top-k by integer inner product over a bit-sliced index.

Components are scaled and floored to integers. A block of the index holds some thousand vectors:
their exact components, and the components cut to BITS bits as bitmaps, one bit of one component
of all rows each. A query adds these bitmaps, weighted by its own components, with carry-save
bitmap arithmetic; the sum is a score in bitmaps that differs from the exact one by a proven
bound. Its slices are walked from the most significant one down: once for the k highest rows,
whose exact scores give a threshold, once for all rows that may reach it. Only these are scored
exactly, so the result is exact.

Rows whose id or vector is null, whose vector is empty or holds a null or non-finite component
take no part. Vectors meet only those of their own length. All rows with a query's id are its
own; queries equal in id and vector are one, queries equal in id alone each get their rows.
Components are kept within the long range; scores beyond it stop at its ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.common import materialize

#: Rows of an index block, bits of a cut component, and queries whose bitmaps are added at once.
BLOCK_ROWS, BITS, TOGETHER = 8192, 5, 8
#: Bytes of queries that one job broadcasts.
QUERY_BYTES = 4 << 20
#: Blocks or queries with larger components are scored exactly throughout, without bitmaps.
WIDE = 1 << 27
MOST_PARTITIONS = 4096

_INDEX = "dim int, n int, ids binary, exact binary, low binary, step long, slices binary, rest double"
_HITS = "query_id long, query_key long, vec_id long, score long"


def quantised(embedding: str | Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as array<long>, null if the vector takes no part."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(v, lambda x: F.floor(F.lit(scale) * x)))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each length in the batch."""
    lists = batch.column("v")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[at[rows][:, None] + np.arange(dim)]


def _block(ids: np.ndarray, v: np.ndarray) -> dict:
    n, dim = v.shape
    if v.min() <= -WIDE or v.max() >= WIDE:
        return {"dim": dim, "n": n, "ids": ids.tobytes(), "exact": v.astype(np.int64).tobytes(), "low": b"", "step": 0, "slices": b"", "rest": 0.0}
    low = v.min(axis=0)
    step = int((v - low).max()) // (1 << BITS) + 1
    cut = (v - low) // step
    rest = v - low - cut * step - (step - 1) / 2
    padded = np.zeros((-(-n // 64) * 64, dim), np.int64)
    padded[:n] = cut
    bits = np.stack([np.packbits((padded >> j & 1).T.astype(bool), axis=1, bitorder="little") for j in range(BITS)])
    return {"dim": dim, "n": n, "ids": ids.tobytes(), "exact": v.astype(np.int32).tobytes(), "low": low.tobytes(), "step": step, "slices": bits.tobytes(), "rest": float(np.sqrt((rest * rest).sum(axis=1)).max())}


def build_index(vectors: DataFrame) -> DataFrame:
    """vectors: vec_id (long), v (array<long>). One row a block, written; blocks of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for rows, v in _matrices(batch):
                for lo in range(0, len(rows), BLOCK_ROWS):
                    yield pa.RecordBatch.from_pylist([_block(ids[rows[lo : lo + BLOCK_ROWS]], v[lo : lo + BLOCK_ROWS])], schema)

    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "exact", "low")), ("step", pa.int64()), ("slices", pa.binary()), ("rest", pa.float64())])
    parts = min(MOST_PARTITIONS, -(-vectors.count() // BLOCK_ROWS)) or 1
    return materialize(vectors.repartition(parts).mapInArrow(run, _INDEX), "bit-slices")


def _added(full: np.ndarray, weight: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Bitmaps of the sums of weight * component over the components: full is BITS x (rows of
    bitmaps, the last empty) x words, weight and pick are queries x components. Equal powers of
    two are gathered in a column and added three to two until one is left; carries move on.
    Returns slices x queries x words, least significant first."""
    planes = int(weight.max(initial=0)).bit_length()
    chosen = []
    for p in range(planes):
        on = (weight >> p & 1).astype(bool)
        order = np.argsort(~on, axis=1, kind="stable")[:, : int(on.sum(axis=1).max())]
        chosen.append(np.where(np.take_along_axis(on, order, 1), np.take_along_axis(pick, order, 1), full.shape[1] - 1))
    out, carries, c = [], [], 0
    while c < planes + BITS - 1 or carries:
        x = np.concatenate([full[c - p][chosen[p]] for p in range(planes) if 0 <= c - p < BITS] + carries, axis=1)
        carries = []
        while (m := x.shape[1]) > 1:
            t = m // 3
            if t:
                a, b, d = x[:, :t], x[:, t : 2 * t], x[:, 2 * t : 3 * t]
                half = a ^ b
                carries.append((a & b) | (half & d))
                x = np.concatenate([half ^ d, x[:, 3 * t :]], axis=1)
            else:
                carries.append(x[:, :1] & x[:, 1:])
                x = x[:, :1] ^ x[:, 1:]
        out.append(x[:, 0] if x.shape[1] else np.zeros((len(weight), full.shape[2]), np.uint64))
        c += 1
    return np.array(out).reshape(len(out), len(weight), full.shape[2])


def _highest(slices: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest sums and all that tie with the last of them."""
    sure, tied = np.zeros_like(valid), valid
    for s in slices[::-1]:
        high = tied & s
        enough = (np.bitwise_count(sure).sum(axis=1) + np.bitwise_count(high).sum(axis=1) >= k)[:, None]
        sure = np.where(enough, sure, sure | high)
        tied = np.where(enough, high, tied & ~s)
    return sure | tied


def _reaching(slices: np.ndarray, valid: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows whose sums are at least least."""
    out = np.zeros_like(valid)
    tied = np.where((np.array([x >> len(slices) for x in least]) == 0)[:, None], valid, 0).astype(np.uint64)
    for j in range(len(slices) - 1, -1, -1):
        bit = np.array([x >> j & 1 for x in least], bool)[:, None]
        high = tied & slices[j]
        out = np.where(bit, out, out | high)
        tied = np.where(bit, high, tied & ~slices[j])
    return out | tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class _Searcher:
    """One block against queries of its length."""

    def __init__(self, block: dict, k: int):
        self.k, self.n, self.dim, self.step, self.rest = k, block["n"], block["dim"], block["step"], block["rest"]
        self.ids = np.frombuffer(block["ids"], np.int64)
        self.v = np.frombuffer(block["exact"], np.int32 if self.step else np.int64).reshape(self.n, self.dim)
        self.most = int(np.abs(self.v.astype(object) if not self.step else self.v).max())
        if self.step:
            self.low = np.frombuffer(block["low"], np.int64)
            bits = np.frombuffer(block["slices"], np.uint64).reshape(BITS, self.dim, -1)
            self.full = np.concatenate([bits, ~bits, np.zeros_like(bits[:, :1])], axis=1)
            self.valid = np.packbits(np.arange(bits.shape[2] * 64) < self.n, bitorder="little").view(np.uint64)
            self.doubles = self.v.astype(np.float64)

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products; in doubles where these are exact."""
        bound = self.most * int(np.abs(q.astype(object)).max()) * self.dim
        if self.step and bound < 1 << 53:
            return (self.doubles[rows] @ q.astype(np.float64)).astype(np.int64)
        if bound < 1 << 63:
            return self.v[rows].astype(np.int64) @ q
        products = self.v[rows].astype(object) @ q.astype(object)
        return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in products], np.int64)

    def _boundary(self, q: np.ndarray, own: list[np.ndarray]) -> list[np.ndarray]:
        """Of each query the rows that may be among its k highest."""
        valid = np.tile(self.valid, (len(q), 1))
        for i, rows in enumerate(own):
            np.bitwise_and.at(valid[i], rows // 64, ~(np.uint64(1) << (rows % 64).astype(np.uint64)))
        weight = np.abs(q)
        slices = _added(self.full, weight, np.arange(self.dim) + np.where(q < 0, self.dim, 0))
        base = q @ self.low - self.step * (np.where(q < 0, weight, 0).sum(axis=1) * ((1 << BITS) - 1)) + (self.step - 1) / 2 * q.sum(axis=1)
        slack = np.sqrt((q.astype(float) ** 2).sum(axis=1)) * self.rest * (1 + 1e-9) + 1 + np.abs(base) * 1e-12
        least = []
        for i, rows in enumerate(map(_rows, _highest(slices, valid, self.k))):
            score = self.exact(q[i], rows)
            kth = np.partition(score, len(score) - self.k)[len(score) - self.k] if len(score) >= self.k else None
            least.append(0 if kth is None else max(0, int(np.floor((float(kth) - slack[i] - base[i]) / self.step))))
        return [_rows(x) for x in _reaching(slices, valid, least)]

    def search(self, ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Position of each query, and ids and scores of its highest rows in this block."""
        for lo in range(0, len(q), TOGETHER):
            part, own = q[lo : lo + TOGETHER], [np.flatnonzero(self.ids == i) for i in ids[lo : lo + TOGETHER]]
            if self.step and part.min() > -WIDE and part.max() < WIDE:
                boundary = self._boundary(part, own)
            else:
                boundary = [np.setdiff1d(np.arange(self.n), x) for x in own]
            for i, rows in enumerate(boundary):
                score = self.exact(part[i], rows)
                best = np.lexsort((self.ids[rows], ~score))[: self.k]
                yield lo + i, self.ids[rows[best]], score[best]


def _search(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, keys, q = queries.value.get(block["dim"], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, block["dim"]), np.int64)))
                found = list(_Searcher(block, k).search(ids, q))
                if found:
                    at = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(int)
                    cols = [ids[at], keys[at], np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "query_key", "vec_id", "score"])

    return run


def _batches(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The written queries in batches of at most QUERY_BYTES, or one longer query, by length."""

    def packed(rows):
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r["v"]), []).append(r)
        return {d: (np.array([r["vec_id"] for r in rs]), np.array([r["query_key"] for r in rs]), np.array([r["v"] for r in rs], np.int64)) for d, rs in by_dim.items()}

    rows, size = [], 0
    for r in queries.toLocalIterator():
        own = 8 * len(r["v"])
        if rows and size + own > QUERY_BYTES:
            yield packed(rows)
            rows, size = [], 0
        rows.append(r)
        size += own
    if rows:
        yield packed(rows)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """vectors, queries: vec_id, embedding. query_id, rank (from 1), vec_id, score: each query's
    k highest integer inner products with other rows, all if fewer, ties to the smaller id. The
    index is read once for each batch of queries; nothing but bounded batches of queries is
    broadcast, and no more than k rows a query leave a block."""
    spark = vectors.sparkSession
    take = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("v")).filter("vec_id is not null and v is not null")
    index = build_index(take(vectors))
    asked = materialize(take(queries).distinct().withColumn("query_key", F.xxhash64("v")), "queries")
    hits = spark.createDataFrame([], _HITS)
    for batch in _batches(asked):
        shared = spark.sparkContext.broadcast(batch)
        hits = hits.unionByName(materialize(index.mapInArrow(_search(shared, k), _HITS), "hits"))
    w = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
