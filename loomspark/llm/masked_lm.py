"""Operator 1, language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from WINDOW tokens on both sides; the
summed conditional log-probabilities of all tokens score a document.

Tokens are words hashed into GROUPS * WITHIN bins; an output is two small softmaxes, the bin's
group and the bin within it, so a token costs 2 * sqrt(V) outputs. Training is data-parallel:
in each round every partition starts from the broadcast parameters, runs stochastic gradient
descent, and Spark averages each parameter row over the partitions that changed it, weighted by
their number of changes. A step hides each token of a piece of STEP places in turn, from its own
prediction only; a partition's pieces are dealt to the rounds, so that every token of every text
is trained exactly once. What is learned grows with the input, while the network stays a few MB.
Scores depend a little on how the rows are partitioned.

Defined results: null and empty texts have no tokens, log-likelihood 0 and no mean; repeated
rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import chunks, prefix_hash, span_hash

GROUPS, WITHIN, DIM, WINDOW = 64, 64, 32, 3
BINS = GROUPS * WITHIN
EDGE = BINS  # the token outside a text
ROUNDS, RATE, STEP = 4, 0.15, 4096
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]


@dataclass
class WindowNet:
    """embed: bins and the edge; position: one scale vector an offset; group, within: output
    layers, their last column the bias."""

    embed: np.ndarray
    position: np.ndarray
    group: np.ndarray
    within: np.ndarray

    @staticmethod
    def start(seed: int = 11) -> WindowNet:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.normal(0, 0.1, s)).astype(np.float32)
        return WindowNet(f(BINS + 1, DIM), 1 + f(len(OFFSETS), DIM), f(GROUPS, DIM + 1), f(BINS, DIM + 1))

    def parts(self) -> list[tuple[str, np.ndarray]]:
        return [("embed", self.embed), ("position", self.position), ("group", self.group), ("within", self.within)]

    def hidden(self, e: np.ndarray) -> np.ndarray:
        """States of the tokens of a piece of a stream whose embeddings are e, without its WINDOW
        first and last ones: each is seen through its neighbours only."""
        n = len(e) - 2 * WINDOW
        h = e[:n] * self.position[0]
        for k in range(1, len(OFFSETS)):
            h += e[WINDOW + OFFSETS[k] :][:n] * self.position[k]
        return np.tanh(h, out=h)

    def log_prob(self, piece: np.ndarray) -> np.ndarray:
        """Log-probability of each token of a piece given its neighbours; 0 for edges."""
        order, tok, cut = _by_group(piece)
        h = _beside_one(self.hidden(self.embed[piece])[order])
        small = _small(self)
        part = _log_chance(h @ self.group.T, tok // WITHIN, small)
        for k in np.flatnonzero(np.diff(cut)):
            lo, hi = cut[k], cut[k + 1]
            part[lo:hi] += _log_chance(h[lo:hi] @ self.within[k * WITHIN : (k + 1) * WITHIN].T, tok[lo:hi] % WITHIN, small)
        out = np.zeros(len(piece) - 2 * WINDOW, np.float32)
        out[order] = part
        return out


def _beside_one(h: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which meets the biases."""
    out = np.ones((len(h), DIM + 1), np.float32)
    out[:, :-1] = h
    return out


def _small(net: WindowNet) -> bool:
    """Whether no output can overflow an exponential: states lie in -1..1."""
    return max(np.abs(net.group).sum(1).max(), np.abs(net.within).sum(1).max()) < 60


def _log_chance(z: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    if not small:
        z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), at]
    return own - np.log(np.exp(z, out=z).sum(1))


def _by_group(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a piece's real tokens ordered by bin, the tokens, and the bounds of the groups."""
    mid = piece[WINDOW : len(piece) - WINDOW]
    real = np.flatnonzero(mid != EDGE)
    order = real[np.argsort(mid[real].astype(np.uint16), kind="stable")]
    tok = mid[order]
    return order, tok, np.searchsorted(tok, np.arange(GROUPS + 1) * WITHIN)


def tokens(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded token stream (WINDOW edges around each text), the places of the real tokens, and
    their bounds by text."""
    s, e = chunk.words()
    bounds = chunk.bounds(s)
    h = span_hash(prefix_hash(chunk.b), s, e)
    doc = np.repeat(np.arange(chunk.n), np.diff(bounds))
    at = np.arange(len(s)) + (doc + 1) * WINDOW
    stream = np.full(len(s) + (chunk.n + 1) * WINDOW, EDGE, np.int32)
    stream[at] = (h >> np.uint64(40)).astype(np.int64) % BINS
    return stream, at, bounds


def pieces(stream: np.ndarray):
    """Runs of STEP places of a padded stream, each with WINDOW places on both sides: every token
    stands in the middle of exactly one."""
    for lo in range(0, len(stream) - 2 * WINDOW, STEP):
        yield stream[lo : lo + STEP + 2 * WINDOW]


def _descend(w: np.ndarray, h: np.ndarray, at: np.ndarray, rate: float, small: bool) -> np.ndarray:
    """One step of a softmax layer w on states h and outputs at; the gradient of the states."""
    n = len(h)
    p = h @ w.T
    if not small:
        p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p *= 1 / p.sum(1, keepdims=True)
    p[np.arange(n), at] -= 1
    back = p @ w[:, :-1]
    w -= (p.T @ h) * np.float32(rate * len(w) / (4 * n))
    return back


def sgd_step(net: WindowNet, touched: dict[str, np.ndarray], piece: np.ndarray, rate: float) -> int:
    """One step on every token of a piece; touched counts the examples behind each row. Returns
    the number of tokens."""
    order, tok, cut = _by_group(piece)
    n = len(tok)
    if not n:
        return 0
    e = net.embed[piece]
    h = net.hidden(e)[order]
    wide, small = _beside_one(h), _small(net)
    back = _descend(net.group, wide, tok // WITHIN, rate, small)
    touched["group"] += n / GROUPS
    for k in np.flatnonzero(np.diff(cut)):
        lo, hi = cut[k], cut[k + 1]
        back[lo:hi] += _descend(net.within[k * WITHIN : (k + 1) * WITHIN], wide[lo:hi], tok[lo:hi] % WITHIN, rate, small)
        touched["within"][k * WITHIN : (k + 1) * WITHIN] += (hi - lo) / WITHIN
    back *= 1 - h * h
    full = np.zeros((len(piece) - 2 * WINDOW, DIM), np.float32)
    full[order] = back
    # the gradient of a place is the sum over the tokens that see it
    grad = np.zeros_like(e)
    for k, o in enumerate(OFFSETS):
        grad[WINDOW + o :][: len(full)] += full * net.position[k]
        net.position[k] -= rate * np.einsum("nd,nd->d", full, e[WINDOW + o :][: len(full)]) / n
    touched["position"] += n
    # each row moves by the mean of its own gradients
    order = np.argsort(piece.astype(np.uint16), kind="stable")
    ids = piece[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    count = np.diff(np.append(first, len(ids)))
    net.embed[ids[first]] -= rate * np.add.reduceat(grad[order], first, axis=0) / (count[:, None] + 4).astype(np.float32)
    touched["embed"][ids[first]] += count
    return n


def _trainer(shared, round_: int, rounds: int):
    def train(batches):
        net = WindowNet(*[a.copy() for _, a in shared.value.parts()])
        touched = {k: np.zeros(len(a)) for k, a in net.parts()}
        seen = 0
        for batch in batches:
            for chunk in chunks(batch.column(0), 1 << 19):
                for piece in pieces(tokens(chunk)[0]):
                    if seen % rounds == round_:
                        sgd_step(net, touched, piece, RATE)
                    seen += 1
        for name, a in net.parts():
            rows = np.flatnonzero(touched[name] > 0)
            if len(rows):
                wide = np.zeros((len(rows), DIM + 1))
                wide[:, : a.shape[1]] = a[rows]
                weight = touched[name][rows]
                cols = [pa.array([name] * len(rows)), pa.array(rows.astype(np.int32)), pa.array(weight)]
                cols += [pa.array((wide[:, j] * weight).astype(np.float32)) for j in range(DIM + 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "row", "weight", *[f"v{j}" for j in range(DIM + 1)]])

    return train


def fit(docs: DataFrame, rounds: int = ROUNDS) -> WindowNet:
    """Rounds of local descent and Spark-side averaging, over every token of every document in all."""
    net = WindowNet.start()
    sc = docs.sparkSession.sparkContext
    values = [f"v{j}" for j in range(DIM + 1)]
    schema = "part string, row int, weight double, " + ", ".join(f"{v} float" for v in values)
    for k in range(rounds):
        shared = sc.broadcast(net)
        local = docs.select("text").mapInArrow(_trainer(shared, k, rounds), schema)
        mean = local.groupBy("part", "row").agg(*[(F.sum(v) / F.sum("weight")).alias(v) for v in values])
        got = mean.toPandas()  # one row a parameter row: fixed by the network
        for name, a in net.parts():
            rows = got[got["part"] == name]
            a[rows["row"].to_numpy()] = rows[values[: a.shape[1]]].to_numpy(np.float32)
    return net


def _scorer(shared):
    def score(batches):
        net = shared.value
        for batch in batches:
            total, count = [], []
            for chunk in chunks(batch.column("text"), 1 << 19):
                stream, at, bounds = tokens(chunk)
                logp = np.concatenate([net.log_prob(piece) for piece in pieces(stream)])[at - WINDOW] if len(at) else np.zeros(0)
                cum = np.concatenate([[0.0], np.cumsum(logp, dtype=np.float64)])
                total.append(cum[bounds[1:]] - cum[bounds[:-1]])
                count.append(np.diff(bounds))
            total = np.concatenate(total) if total else np.zeros(0)
            count = (np.concatenate(count) if count else np.zeros(0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(total)], names=["doc_id", "n_tokens", "log_likelihood"])

    return score


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, log_likelihood (summed conditional natural
    log-probabilities), mean_log_prob and pseudo_perplexity (null without tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, rounds))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = src.mapInArrow(_scorer(shared), "doc_id long, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.withColumn("mean_log_prob", mean).withColumn("pseudo_perplexity", F.exp(-F.col("mean_log_prob")))
