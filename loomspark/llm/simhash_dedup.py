"""Operator 6, SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are compared as a whole only where a part of their bits already agrees. Correlated
bits are grouped into partitions; a dynamic program gives each partition its own threshold so
that the thresholds' sum is radius - partitions + 1 and the estimated number of candidates is
least; a fingerprint probes every partition with all values within its threshold and stays a
candidate if another fingerprint has such a value. Any pair within the radius agrees so in at
least one partition, whatever the grouping: estimates only decide the cost.

similar_texts finds near-duplicates by the similarity of shingle sets: SimHash first, then an
exact prefix filter for what lies beyond its radius.

Candidates are verified without listing pairs: for radius 2, two fingerprints link exactly if
they share a value at distance at most 1 from both (radius 0 and 1 likewise), and at most 65
fingerprints surround a value. Equal fingerprints are one node from the start, so copies never
meet as pairs. Components come from star contractions.

Defined results: null and empty texts have fingerprint zero and link like any other; the
smallest doc_id ignores nulls; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, combinations, repeat
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import broadcast_if_small, by_sorting, carried, doc_hash, join_counted, materialize, maybe_in
from loomspark.llm.components import components

SHINGLE, RADIUS, BITS = 3, 2, 64
#: What similar_texts calls similar.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: In a group of up to SMALL texts all pairs are compared; in a larger one, its members with
#: pivots: at most PIVOTS at a time in the first round and in each later one.
SMALL, PIVOTS = 8, (1, 256, 2048)
#: Shingles are ordered by how often their bin, the top bits of their hash, occurs in the corpus.
BIN_BITS, LANES = 18, 16
#: Bits of a set's parity signature.
PARITY = 512
#: Fingerprints that the partitioning is fitted on, by hash; the join itself is exact.
FIT_SAMPLE = 2000
#: Number of fingerprints that the thresholds are chosen for, whatever the input: the plan is
#: the same at every size. Sampled pairs up to NEAR bits apart are left out of its estimates.
PLAN_SIZE, NEAR = 1 << 24, 16
_BLOCK = 1 << 15


def shingle_digests(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of a text, repeats included, in blocks; fewer words
    are one shingle, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    lo, hi = start[:n].tolist(), (start[min(shingle, len(words)) :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _BLOCK):
        part = [digest(joined[a:b], 42) for a, b in zip(lo[k : k + _BLOCK], hi[k : k + _BLOCK], strict=True)]
        yield np.array(part, np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_digests(text, shingle):
        n += len(h)
        # bits of up to 255 hashes fit a byte: sum narrow blocks first
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(0, dtype=np.uint8)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp)], names=["doc_id", "h", "fp"])

    return run


def _parity(s: np.ndarray) -> np.ndarray:
    """Parity of the members in each of PARITY bins: two sets differ in at least as many members
    as their signatures in bits."""
    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(sets: list[np.ndarray], dtype: type = np.uint64) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, dtype), *sets])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64 if dtype is np.uint64 else np.int32)))


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_digests(text, shingle)]))


def _bins(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _bin_rows(shingle: int):
    def run(batches):
        total, held, waiting = np.zeros(1 << BIN_BITS, np.int64), [], 0
        for batch in batches:
            for t in batch.column("text"):
                for h in shingle_digests(t.as_py(), shingle):
                    held.append(_bins(h))
                    waiting += len(h)
                    if waiting >= 1 << 20:
                        total += np.bincount(np.concatenate(held), minlength=len(total))
                        held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        wide = total.reshape(-1, LANES)
        cols = [pa.array(np.arange(len(wide), dtype=np.int32))] + [pa.array(np.ascontiguousarray(wide[:, j])) for j in range(LANES)]
        yield pa.RecordBatch.from_arrays(cols, names=["bins", *[f"n{j}" for j in range(LANES)]])

    return run


def bin_counts(src: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of the corpus fall into each of the 2^BIN_BITS bins: a table of fixed size,
    whatever the input."""
    lanes = [f"n{j}" for j in range(LANES)]
    rows = src.select("text").mapInArrow(_bin_rows(shingle), "bins int, " + ", ".join(f"{x} long" for x in lanes))
    got = rows.groupBy("bins").agg(*[F.sum(x).alias(x) for x in lanes]).toPandas()
    out = np.zeros(1 << BIN_BITS, np.int64)
    if len(got):
        out.reshape(-1, LANES)[got["bins"].to_numpy()] = got[lanes].to_numpy(np.int64)
    return out


def _sketches(shingle: int, similarity: float, often):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = [_shingle_set(t, shingle) for t in texts]
            keys = [xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets]
            # all sets are ordered alike, so similar ones share a member of these prefixes
            prefixes = [x[np.lexsort((x, often.value[_bins(x)]))[: len(x) - ceil(similarity * len(x) - 1e-9) + 1]] for x in sets]
            fps = [fingerprint(t, shingle) for t in texts]
            longs = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            sizes = pa.array([len(x) for x in sets], pa.int32())
            cols = [batch.column("doc_id"), batch.column("h"), longs(keys), sizes, longs(fps), _lists(prefixes), _lists([_parity(x) for x in sets])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "node", "n", "fp", "prefix", "parity"])

    return run


def _shingle_sets(shingle: int):
    def run(batches):
        for batch in batches:
            # lower halves of the digests: a collision, in about n * n / 2^32 of the pairs, adds one
            # shared member and so never loses a link
            sets = [np.unique(_shingle_set(t, shingle).astype(np.uint32)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(sets, np.uint32)], names=["node", "s"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h, fp of every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", doc_hash().alias("h"))
    return src.mapInArrow(_fingerprints(shingle), "doc_id long, h long, fp long")


def _bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches):
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        x = _bits_of(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.reshape(-1))], names=["i", "j", "n"])


def correlations(fps: DataFrame, n: int) -> np.ndarray:
    """Absolute correlations of all bits over all fingerprints."""
    counts = fps.select("fp").mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    joint = np.zeros((BITS, BITS))
    for r in counts:
        joint[r["i"], r["j"]] = r["n"] / max(n, 1)
    p = np.diag(joint)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((joint - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width: each grows by the free bit most correlated with it."""
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS * (k + 1) // parts - BITS * k // parts
        chosen = [min(free, key=lambda b: (-sum(corr[b, c] for c in free if c != b), b))]
        free.discard(chosen[0])
        while len(chosen) < width:
            b = min(free, key=lambda b: (-corr[b, chosen].sum(), b))
            chosen.append(b)
            free.discard(b)
        out.append(sorted(chosen))
    return out


def allocate(cost: Sequence[Sequence[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t[i] >= -1 (-1: unused) with the given sum and the least summed cost;
    cost[i][t + 1] is partition i's cost at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, t) in best.items():
            for k, extra in enumerate(row):
                key = used + k - 1
                if key not in step or c + extra < step[key][0]:
                    step[key] = (c + extra, [*t, k - 1])
        best = step
    return best[total]


def plan(fps: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions of bits and their thresholds, for the least estimated work."""
    n = fps.count()
    if not n:
        return []
    corr = correlations(fps, n)
    sample = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(FIT_SAMPLE).collect()], np.int64)
    bits = _bits_of(sample).astype(np.float32)
    whole = bits.sum(1)
    far = whole[:, None] + whole[None, :] - 2 * bits @ bits.T > NEAR
    best = None
    for parts in range(2, radius + 3):
        groups = group_bits(corr, parts)
        cost = []
        for g in groups:
            x = bits[:, g]
            apart = x.sum(1)[:, None] + x.sum(1)[None, :] - 2 * x @ x.T
            near = apart[far]
            row = [0.0]
            for t in range(radius + 1):
                chance = sum(comb(len(g), k) for k in range(t + 1)) / 2.0 ** len(g)
                share = max(chance, float((near <= t).mean()) if len(near) else 0.0)
                probes = sum(comb(len(g), k) for k in range(t + 1))
                # probes are rows to shuffle; a candidate brings 65 more rows
                row.append(probes + 65 * min(1.0, PLAN_SIZE * share))
            cost.append(row)
        got = allocate(cost, radius - parts + 1)
        if best is None or got[0] < best[0]:
            best = (*got, groups)
    return [(g, t) for g, t in zip(best[2], best[1], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(fps: DataFrame, partitions: Sequence[tuple[list[int], int]]) -> DataFrame:
    """fps: t (table), fp, distinct. Those that another one of the table meets within some
    partition's threshold.

    A probe is shuffled as its flipped fingerprint x and one number c (table and probe); what it
    is joined on and whom it belongs to follow from these two."""
    masks, numbers, flips = [], [], []
    for k, (bits, t) in enumerate(partitions):
        for r in range(t + 1):
            for c in combinations(bits, r):
                masks.append(_signed(sum(1 << b for b in bits)))
                numbers.append(k)
                flips.append(_signed(sum(1 << b for b in c)))
    of = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.pmod("c", F.lit(len(flips))))
    entry = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in sorted(set(zip(numbers, masks, strict=True)))]
    counts = fps.select("t", F.explode(F.array(*entry)).alias("e")).groupBy("t", "e.k", "e.v").agg(F.count("*").alias("n"))
    counts = counts.withColumnRenamed("t", "e_t")
    probes = fps.select("t", F.posexplode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("p", "x"))
    asked = probes.select((F.col("t") * len(flips) + F.col("p")).cast("int").alias("c"), "x")
    table = F.floor(F.col("c") / len(flips)).cast("int")
    same = (table == F.col("e_t")) & (of(numbers) == F.col("k")) & (F.col("x").bitwiseAND(of(masks)) == F.col("v"))
    met = asked.join(by_sorting(counts), same).filter((F.col("n") > 1) | (of(flips) != 0))
    return met.select(F.col("e_t").alias("t"), F.col("x").bitwiseXOR(of(flips)).alias("fp")).distinct()


def links(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges t, a, b that connect exactly the candidates (t, fp) linked within the radius (at
    most 2)."""
    if radius > 2:
        raise ValueError("verification by common neighbours covers radius 0 to 2")
    single = [_signed(1 << b) for b in range(BITS)]
    flips = F.array(*[F.lit(f) for f in ([0, *single] if radius else [0])])
    around = found.select("t", "fp", F.explode(flips).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("x"))
    if radius < 2:  # the neighbour itself must be there
        there = found.select("t", F.col("fp").alias("b"))
        return around.withColumnRenamed("x", "b").join(there, ["t", "b"]).filter("fp <> b").select("t", F.col("fp").alias("a"), "b")
    hubs = around.groupBy("t", "x").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_list("fp").alias("members"))
    return hubs.filter("a <> z").select("t", "a", F.explode("members").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, h, fp, component_id."""
    rows = materialize(fingerprints(docs, shingle), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    partitions = plan(nodes.select("fp"), radius)
    if not partitions:
        return rows.withColumn("component_id", F.col("doc_id"))
    found = materialize(candidates(nodes.select(F.lit(0).alias("t"), "fp"), partitions), "simhash-found")
    comp = components(links(found, radius).select("a", "b"))
    rooted = nodes.join(by_sorting(comp), nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialize(rooted.join(by_sorting(smallest), "root").select(F.col("fp").alias("n_fp"), "component_id"), "simhash-comp")
    return rows.join(broadcast_if_small(by_fp), F.col("fp") == F.col("n_fp"), "left").select("doc_id", "h", "fp", "component_id")


def hex_fingerprint(column: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _classes(edges: DataFrame) -> DataFrame:
    out = components(edges)
    return out.select(F.col("node").alias("c_node"), "root")


def _joined(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Written classes (c_node, root) after new edges (a, b): only the classes that these tie are
    looked at. Nodes without an edge are in no class."""
    if edges.isEmpty():
        return classes
    named = lambda end: classes.select(F.col("c_node").alias(end), F.col("root").alias(f"r_{end}"))
    tied = edges.join(by_sorting(named("a")), "a", "left").join(by_sorting(named("b")), "b", "left")
    tied = tied.select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b")).filter("a <> b")
    tied = components(tied).select(F.col("node").alias("root"), F.col("root").alias("to"))
    tied = materialize(tied, "similar-tied")
    old = classes.join(broadcast_if_small(tied), "root", "left").select("c_node", F.coalesce("to", "root").alias("root"))
    new = tied.select(F.col("root").alias("c_node"), F.col("to").alias("root")).join(by_sorting(classes), "c_node", "left_anti")
    return materialize(old.unionByName(new), "similar-classes")


def _with_both(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Written, distinct pairs (a, b) of nodes with the value of both, as l and r; values: node,
    value. One b may stand in very many pairs."""
    counts = materialize(pairs.groupBy("b").agg(F.count("*").alias("count")), "similar-counts")
    right = counts.join(by_sorting(values.select(F.col("node").alias("b"), F.col(value).alias("r"))), "b")
    left = pairs.join(by_sorting(values.select(F.col("node").alias("a"), F.col(value).alias("l"))), "a")
    return join_counted(left, right, ["b"], "count", F.col("a"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, src: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the written, distinct pairs (a, b) of nodes whose shingle sets are similar enough.
    Pairs whose parity signatures differ too much cannot be; the sets of the others are compared.
    nodes: node, n, parity; texts: node and a row of src (w_h, w_id) that has it."""
    both = _with_both(pairs, nodes.withColumn("v", F.struct("n", "parity")), "v")
    apart = sum(F.bit_count(F.get("l.parity", F.lit(i)).bitwiseXOR(F.get("r.parity", F.lit(i)))) for i in range(PARITY // 64))
    n = F.col("l.n") + F.col("r.n")
    near = materialize(both.filter(apart <= n - 2 * F.ceil(n * (similarity / (1 + similarity)) - 1e-9)).select("a", "b"), "similar-near")
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    want = materialize(texts.join(by_sorting(ends), "node"), "similar-want")
    hit = maybe_in(src, "h", want.select("w_h")).filter("maybe")
    hit = hit.join(broadcast_if_small(want), (F.col("h") == F.col("w_h")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    sets = hit.select("node", "text").mapInArrow(_shingle_sets(shingle), "node long, s array<int>")
    both = _with_both(near, materialize(sets, "similar-sets"), "s")
    shared = F.size(F.array_intersect("l", "r"))
    union = F.size("l") + F.size("r") - shared
    # equal rows of src give a set more than once
    return materialize(both.filter(shared / F.greatest(union, F.lit(1)) >= similarity).select("a", "b").distinct(), "similar-edges")


def _simhash_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs of nodes (node, fp) that SimHash offers: each with the representative of its
    fingerprint's component."""
    reps = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "similar-fps")
    partitions = plan(reps.select("fp"), radius)
    if not partitions:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    found = materialize(candidates(reps.select(F.lit(0).alias("t"), "fp"), partitions), "similar-found")
    comp = components(links(found, radius).select("a", "b")).select(F.col("node").alias("fp"), F.col("root").alias("r_fp"))
    roots = comp.join(by_sorting(reps.select(F.col("fp").alias("r_fp"), F.col("rep").alias("b"))), "r_fp").select("fp", "b")
    own = reps.join(by_sorting(roots), "fp", "left").select("fp", F.coalesce("b", "rep").alias("b"))
    return nodes.join(by_sorting(own), "fp").select(F.col("node").alias("a"), "b").filter("a <> b")


def similar_texts(docs: DataFrame, radius: int = RADIUS, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Near-duplicate classes of texts whose sets of word shingles have at least the similarity.

    Texts with equal sets are one node. SimHash within the radius joins what is nearest: each
    node is verified against its component's representative. A similarity of 0.8 leaves the
    fingerprints about 10 bits apart, where no partitioning is selective, so an exact prefix
    filter finds the rest: the sets' members are ordered from rare to frequent, and similar sets
    share one of their first n - ceil(similarity * n) + 1. Where few nodes share such a member, all
    their pairs are compared. Where many do, all of other classes are compared with pivots, first
    with the one that shares most; pivots leave, and rounds go on until what is left of every such
    group is one class. A group of near copies thus takes one round, and no link is lost.

    Places in the order spare more: the first member that two sets share has the i-th and j-th
    place in them, so they share no more than the smaller of n - i and m - j; pairs for which this
    is too few at a member either share an earlier one, whose group has them, or are not similar.
    The smaller of two similar sets has the member early (n - i reaches what two sets of its size
    must share), so only such nodes are pivots, and a group ends when it has no more of them. A
    frequent member comes late in most sets, so its group ends soon.

    Returns doc_id, h, rows (number of equal rows) and root, which names the class."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", doc_hash().alias("h"))
    often = docs.sparkSession.sparkContext.broadcast(bin_counts(src, shingle))
    rows = src.mapInArrow(_sketches(shingle, similarity, often), "doc_id long, h long, node long, n int, fp long, prefix array<long>, parity array<long>")
    rows = materialize(rows, "similar")
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "prefix", "parity")], F.min(F.struct("h", "doc_id")).alias("one"))
    nodes = materialize(nodes, "similar-nodes")
    texts = nodes.select("node", F.col("one.h").alias("w_h"), F.col("one.doc_id").alias("w_id"))
    check = lambda pairs: _verified(materialize(pairs.distinct(), "similar-pairs"), nodes, texts, src, shingle, similarity)
    # members of prefixes that several nodes share
    places = nodes.select("node", "n", F.posexplode("prefix").alias("i", "g"))
    shared = materialize(places.groupBy("g").agg(F.count("*").alias("count")).filter("count > 1"), "similar-shared")
    places = maybe_in(places, "g", shared.select("g")).filter("maybe").drop("maybe")
    places = materialize(join_counted(places, shared.withColumn("size", F.col("count")), ["g"], "count", F.col("node")), "similar-places")
    weight = places.groupBy("node").agg(F.sum("size").alias("weight"))
    order = F.struct((-F.col("weight")).alias("w"), "node", "n").alias("order")
    groups = materialize(places.join(by_sorting(weight), "node").select("g", "node", "n", "i", "size", order), "similar-groups")
    least = lambda n, m: F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)
    # x, y: n and i of two nodes; what comes before the first member they share is not shared
    close = lambda x, y: (F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]) - 1e-9) & (F.least(x["n"] - x["i"], y["n"] - y["i"]) >= least(x["n"], y["n"]))
    early = F.col("n") - F.col("i") >= least(F.col("n"), F.col("n"))
    pairs = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    offered = _simhash_pairs(nodes.select("node", "fp"), radius).select(*pairs("a", "b"))
    small = groups.filter(F.col("size") <= SMALL).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("node", "n", "i"))).alias("m"))
    each = small.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    each = each.filter(close(F.col("x"), F.col("y"))).select(*pairs("x.node", "y.node"))
    edges = check(offered.unionByName(each))
    large = groups.filter(F.col("size") > SMALL)
    classes = materialize(_classes(edges), "similar-classes")
    for lots in chain(PIVOTS, repeat(PIVOTS[-1])):
        now = large.join(by_sorting(classes), F.col("node") == F.col("c_node"), "left").withColumn("class", F.coalesce("root", "node")).drop("c_node", "root")
        # one pivot a lot; what is left of a group that has become small is all compared
        lot = F.when(F.col("size") <= SMALL, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(lots))).alias("lot")
        firsts = now.groupBy("g", lot).agg(F.min(F.when(early, F.struct("order", "node", "n", "i", "class"))).alias("p"), F.min("class").alias("c0"), F.max("class").alias("c1"), F.count("*").alias("count"))
        pivots = firsts.groupBy("g").agg(F.collect_list("p").alias("pivots"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.sum("count").alias("count"))
        pivots = pivots.filter("c0 <> c1 and size(pivots) > 0").withColumn("rest", F.col("count") - F.size("pivots"))
        pivots = materialize(pivots.drop("c0", "c1"), "similar-pivots")
        if pivots.isEmpty():
            break
        asked = join_counted(now, pivots, ["g"], "count", F.col("node"))
        own = F.struct("n", "i", "class").alias("own")
        near = F.filter("pivots", lambda p: (p["class"] != F.col("own.class")) & close(F.col("own"), p))
        far = asked.select("node", "pivots", own).select("node", F.explode(near).alias("p"))
        far = materialize(far.select(*pairs("node", "p.node")), "similar-far")
        if not far.isEmpty():
            classes = _joined(classes, check(far))
        left = asked.filter(~F.array_contains("pivots.node", F.col("node")))
        large = materialize(left.select("g", "node", "n", "i", F.col("rest").alias("size"), "order"), "similar-groups")
    by_text = rows.select("doc_id", "h", "node").join(by_sorting(classes), F.col("node") == F.col("c_node"), "left")
    return by_text.withColumn("root", F.coalesce("root", "node")).groupBy("doc_id", "h", "root").agg(F.count("*").alias("rows"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without all but one document of each class of similar or equal texts: the one with
    the smallest doc_id (nulls last; then the smallest hash of the text; of equal rows, one)."""
    found = materialize(similar_texts(docs, radius), "similar-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    keep = materialize(found.groupBy("root").agg(F.min(rank).alias("best"), F.count("*").alias("count")), "similar-keep")
    judged = join_counted(found, keep, ["root"], "count", F.struct("doc_id", "h"))
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))
    names = [F.col("doc_id").alias("g_id"), F.col("h").alias("g_h")]
    gone = materialize(judged.filter(~best).select(*names), "similar-gone")
    again = materialize(judged.filter(best & (F.col("rows") > 1)).select(*names), "similar-again")
    own = carried(docs)
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h"))
    out = own.join(broadcast_if_small(gone), same, "left_anti")
    if not again.isEmpty():
        # of equal rows one stays; which one is written down, so that it cannot change
        equal = materialize(out.join(broadcast_if_small(again), same, "left_semi").withColumn("place", F.monotonically_increasing_id()), "similar-equal")
        one = equal.groupBy("doc_id", "h").agg(F.min("place").alias("place")).select("place")
        out = out.join(broadcast_if_small(again), same, "left_anti").unionByName(equal.join(by_sorting(one), "place", "left_semi").drop("place"))
    return out.select("row.*")
