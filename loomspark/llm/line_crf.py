"""Operator 2, quality classifier: a linear-chain conditional random field labels every line
good or bad from its own and its neighbours' features; the lines' forward-backward marginals,
weighted by length, give the document's quality.

The field is trained in numpy on a bounded sample (SAMPLE documents, by hash of doc_id, without
those over FIT_BYTES) of the labelled rows given for learning; a sampled document's lines carry its
label. All texts, of any length, are scored whole. A logistic link
fitted on the same sample turns the weighted marginal into a probability.

Defined results: null and empty texts are one empty line and are scored; rows without labels
are only scored; no labelled rows at all give every document the score 0.5; repeated rows are
scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import CHUNK_BYTES, chunks, per_text, prefix_hash, span_hash

#: Documents to learn from, and bytes of one of them, at most; lines that advance one by one.
SAMPLE, FIT_BYTES, STRETCH = 3000, 1 << 16, 256
STEPS, RATE, RIDGE = 120, 0.2, 1e-3
OWN = 11
FEATURES = 3 * OWN + 2


def _lookup(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _LOWER, _DIGIT = _lookup(bytes(range(65, 91))), _lookup(bytes(range(97, 123))), _lookup(b"0123456789")
_SYMBOL, _MARK, _END, _BLANK = _lookup(b"#*$%&|<>"), _lookup(b"!?"), _lookup(b".,;:"), _lookup(b" \t\n\x0b\x0c\r")


def line_features(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (own, previous, next, two edges), their byte lengths and texts."""
    s, e, owner = chunk.lines()
    b = chunk.b
    n = e - s
    size = np.maximum(n, 1)

    def share(t):
        total = np.concatenate([[0], np.cumsum(t[b])])
        return (total[e] - total[s]) / size

    letters = share(_UPPER), share(_LOWER)
    ws, we = chunk.words()
    first, last = np.searchsorted(ws, s), np.searchsorted(ws, e)
    words = last - first
    prefix = prefix_hash(b)
    h = span_hash(prefix, s, e)
    order = np.lexsort((h, owner))
    again = np.zeros(len(h), bool)
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again[order[1:]] |= same
    again[order[:-1]] |= same
    wh = span_hash(prefix, ws, we)
    line_of = np.repeat(np.arange(len(s)), words)
    if len(line_of):
        key = np.lexsort((wh[: len(line_of)], line_of)) if len(wh) == len(line_of) else np.arange(0)
        wk, lk = wh[key], line_of[key]
        fresh = np.ones(len(wk), bool)
        fresh[1:] = (wk[1:] != wk[:-1]) | (lk[1:] != lk[:-1])
        distinct = np.bincount(lk[fresh], minlength=len(s))
    else:
        distinct = np.zeros(len(s))
    own = np.stack(
        [
            np.log1p(n) / 5,
            letters[0] * 3,
            letters[1],
            share(_DIGIT) * 3,
            np.minimum(share(_SYMBOL) * 10, 3),
            np.minimum(share(_MARK) * 10, 3),
            share(_END) * 5,
            np.minimum(n / np.maximum(words, 1) / 10, 3),
            again.astype(float),
            distinct / np.maximum(words, 1),
            (n == 0).astype(float),
        ],
        axis=1,
    )
    x = np.zeros((len(s), FEATURES))
    x[:, :OWN] = own
    inner = owner[1:] == owner[:-1]
    x[1:, OWN : 2 * OWN] = own[:-1] * inner[:, None]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:] * inner[:, None]
    x[:, -2] = 1
    x[0:1, -1] = 1
    x[1:, -1] += ~inner
    return x, n, owner


@dataclass
class LineCrf:
    w: np.ndarray  # unary weight of the good state against the bad one
    trans: np.ndarray  # 2 x 2 transition scores, 1 is good
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, owner: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, expected transition counts (each counting weight of its first
        line), log partition of each text with lines.

        Texts are cut into stretches of at most STRETCH lines, and all stretches advance together,
        line by line. Those of one text are tied by the 2 x 2 log-matrices of their products, so a
        text of n lines takes about STRETCH + n / STRETCH steps."""
        trans, u = self.trans, np.stack([np.zeros(len(x)), x @ self.w], axis=1)
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(x) else np.zeros(0, int)
        size = np.diff(np.concatenate([begins, [len(x)]]))
        # stretches: of every text the first ones, then the second ones, and so on
        rank = np.concatenate([np.full(int((size > k * STRETCH).sum()), k) for k in range(-(-int(size.max(initial=0)) // STRETCH))] or [[]]).astype(int)
        text = np.concatenate([np.flatnonzero(size > k * STRETCH) for k in range(int(rank.max(initial=-1)) + 1)] or [[]]).astype(int)
        at = begins[text] + rank * STRETCH
        lines = np.minimum(size[text] - rank * STRETCH, STRETCH)
        # longest first, so that those with a t-th line are the first live[t]
        by_size = np.argsort(-lines, kind="stable")
        rank, text, at, lines = rank[by_size], text[by_size], at[by_size], lines[by_size]
        live = [int(np.searchsorted(-lines, -t, "left")) for t in range(int(lines.max(initial=0)))]
        of_rank = np.split(np.argsort(rank, kind="stable"), np.cumsum(np.bincount(rank))[:-1]) if len(rank) else []
        slot = np.zeros((len(begins), len(of_rank)), int)
        slot[text, rank] = np.arange(len(text))
        # products of the stretches of texts that have more than one
        whole = np.zeros((len(at), 2, 2))
        several = size[text] > STRETCH
        for t in range(len(live) if several.any() else 0):
            s = np.flatnonzero(several[: live[t]])
            i = at[s] + t
            step = trans[None] + u[i][:, None, :]
            if t == 0:
                start = np.array([[0.0, -np.inf], [-np.inf, 0.0]])[None] + u[i][:, None, :]
                whole[s] = np.where((rank[s] == 0)[:, None, None], start, step)
            else:
                a, b = whole[s][:, :, :, None], step[:, None]
                whole[s] = np.logaddexp(a[:, :, 0] + b[:, :, 0], a[:, :, 1] + b[:, :, 1])
        # what lies before and behind each stretch
        before, behind = np.zeros((len(at), 2)), np.zeros((len(at), 2))
        for k in range(1, len(of_rank)):
            s = of_rank[k]
            p = slot[text[s], k - 1]
            before[s] = np.logaddexp(before[p][:, :1] + whole[p][:, 0], before[p][:, 1:] + whole[p][:, 1])
        for k in range(len(of_rank) - 1, 0, -1):
            s = of_rank[k]
            behind[slot[text[s], k - 1]] = np.logaddexp(whole[s][:, :, 0] + behind[s][:, :1], whole[s][:, :, 1] + behind[s][:, 1:])
        alpha, beta = u.copy(), np.zeros_like(u)
        later = np.flatnonzero(rank > 0)
        alpha[at[later]] += np.logaddexp(before[later][:, :1] + trans[0], before[later][:, 1:] + trans[1])
        for t in range(1, len(live)):
            i = at[: live[t]] + t
            alpha[i] += np.logaddexp(alpha[i - 1, :1] + trans[0], alpha[i - 1, 1:] + trans[1])
        beta[at + lines - 1] = behind
        for t in range(len(live) - 2, -1, -1):
            i = at[: live[t + 1]] + t
            nxt = u[i + 1] + beta[i + 1]
            beta[i] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
        end = begins + size - 1
        z = np.logaddexp(alpha[end, 0], alpha[end, 1])
        z_line = np.repeat(z, size)
        good = np.exp(alpha[:, 1] + beta[:, 1] - z_line)
        pair = np.zeros((2, 2))
        j = np.flatnonzero(owner[1:] == owner[:-1])
        for a in (0, 1):
            for c in (0, 1):
                share = np.exp(alpha[j, a] + trans[a, c] + u[j + 1, c] + beta[j + 1, c] - z_line[j])
                pair[a, c] = share.sum() if weight is None else share @ weight[j]
        return good, pair, z

    def score(self, x: np.ndarray, n: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted marginal and probability of each text."""
        good, _, _ = self.marginals(x, owner)
        weight = n + 1.0
        q = np.bincount(owner, good * weight, texts) / np.maximum(np.bincount(owner, weight, texts), 1e-9)
        return q, 1 / (1 + np.exp(-np.clip(self.slope * _logit(q) + self.shift, -30, 30)))


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def train(texts: list[str], good: list[int]) -> LineCrf:
    """Gradient ascent on the mean over documents of a line's conditional log-likelihood."""
    model = LineCrf(np.zeros(FEATURES), np.zeros((2, 2)))
    if not texts or len(set(good)) < 2:
        model.slope = 0.0
        return model
    xs, ns, owners, base = [], [], [], 0
    for chunk in chunks(pa.array(texts, pa.large_string())):
        x, n, owner = line_features(chunk)
        xs.append(x)
        ns.append(n)
        owners.append(owner + base)
        base += chunk.n
    x, n, owner = np.concatenate(xs), np.concatenate(ns), np.concatenate(owners)
    doc = np.array(good, float)
    y = doc[owner]
    # A document weighs the same however many lines it has; the link learns the class balance.
    weight = 1 / np.bincount(owner)[owner]
    inner = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        seen[a, a] = weight[:-1][(y[1:] == a) & inner].sum()
    m = [np.zeros(FEATURES), np.zeros((2, 2))]
    v = [np.zeros(FEATURES), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):
        p, pair, _ = model.marginals(x, owner, weight)
        grads = [x.T @ ((y - p) * weight) / base - RIDGE * model.w, (seen - pair) / base - RIDGE * model.trans]
        for k, (param, g) in enumerate(zip((model.w, model.trans), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            param += RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    q, _ = model.score(x, n, owner, base)
    f = np.stack([_logit(q), np.ones(base)], axis=1)
    link = np.array([1.0, 0.0])
    for _ in range(25):  # Newton steps of a slightly shrunk logistic regression
        p = 1 / (1 + np.exp(-np.clip(f @ link, -30, 30)))
        h = (f * (p * (1 - p))[:, None]).T @ f + np.diag([0.05, 0.05])
        link = link + np.clip(np.linalg.solve(h, f.T @ (doc - p) - 0.05 * link), -1, 1)
    model.slope, model.shift = float(max(link[0], 0)), float(link[1])
    return model


def _scorer(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            q, p, lines = [], [], []
            for chunk in chunks(batch.column("text"), CHUNK_BYTES):
                x, n, owner = line_features(chunk)
                a, c = model.score(x, n, owner, chunk.n)
                q.append(a)
                p.append(c)
                lines.append(np.bincount(owner, minlength=chunk.n))
            cols = [np.concatenate(v) if v else np.zeros(0) for v in (p, q, lines)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0].astype(float)), pa.array(cols[1].astype(float)), pa.array(cols[2].astype(np.int64))],
                names=["doc_id", "score", "good_share", "n_lines"],
            )

    return score


def line_labels(model: LineCrf, texts: list[str]) -> list[np.ndarray]:
    """P(good) of each line of each text."""
    out: list[np.ndarray] = []
    for chunk in chunks(pa.array(texts, pa.large_string())):
        x, _, owner = line_features(chunk)
        good = model.marginals(x, owner)[0]
        out += [good[owner == i] for i in range(chunk.n)]
    return out


def classify(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, score, good_share (length-weighted marginal), n_lines.
    labelled: (doc_id, quality) rows to learn from, joined to docs by doc_id."""
    picked = labelled.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers, so the broadcast is bounded.
    rows = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).join(F.broadcast(picked.withColumnRenamed("doc_id", "p_id")), F.col("doc_id") == F.col("p_id"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).orderBy("doc_id").collect()
    model = train([r["text"] or "" for r in rows], [int(r["quality"] > 0) for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(_scorer(shared), "doc_id long, score double, good_share double, n_lines long")
