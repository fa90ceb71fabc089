"""Operator 8, language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy, with calibrated rejection.

A subword is 1 to 4 UTF-8 bytes of one word, its edges marked by the blank beside it. A text's
feature is the mean embedding of all its subwords; the whole text counts. Training takes a
bounded sample (PER_LANG snippets of at most SNIPPET characters a language, drawn one by one)
of the rows given for learning; every language there is learned. The softmax temperature and the rejection threshold come from a held-back part.

Defined results: null texts and texts without a letter are `und` with score 0; no rows to
learn from makes every text `und`; repeated rows get equal results; empty table, no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import CHUNK_BYTES, broadcast_if_small, chunks, materialize

SIZES = (1, 2, 3, 4)
BUCKET_BITS, DIM = 16, 16
PER_LANG, SNIPPET = 3000, 300
EPOCHS, BATCH, RATE = 4, 64, 2.0
#: Accepted predictions are right at least this often on the calibration part.
ACCEPT = 0.99

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_BLANK] = 0x20


def subwords(chunk, size: int) -> np.ndarray:
    """Bucket of the subword starting at each byte; the bucket after the last one where there is none."""
    none = 1 << BUCKET_BITS
    b = _FOLD[chunk.b]
    n = len(b) - size + 1
    out = np.full(len(b), none, np.int32)
    if n <= 0:
        return out
    code = b[:n].astype(np.uint32)
    for j in range(1, size):
        code = (code << np.uint32(8)) | b[j : n + j]
    code ^= np.uint32(size * 0x01000193)
    code *= np.uint32(2654435769)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    slot = (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    blank = b == 0x20
    bad = blank[:n].copy() if size <= 2 else np.zeros(n, bool)
    for j in range(1, size - 1):
        bad |= blank[j : n + j]
    for j in range(1, size):  # must not run into the next text
        edge = chunk.at[1:] - j
        bad[edge[(edge >= 0) & (edge < n)]] = True
    slot[bad] = none
    out[:n] = slot
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # bucket -> logits, embeddings already times the output matrix
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, chunk) -> np.ndarray:
        total = np.zeros((chunk.n, len(self.langs)))
        count = np.zeros(chunk.n)
        full = chunk.at[1:] > chunk.at[:-1]
        at = chunk.at[:-1][full]
        for size in SIZES:
            slot = subwords(chunk, size)
            if len(at):
                total[full] += np.add.reduceat(self.table[slot], at, axis=0)
                count[full] += np.add.reduceat((slot < len(self.table) - 1).astype(np.int64), at)
        return total / np.maximum(count, 1)[:, None] + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel | None:
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.searchsorted(np.array(langs, object), np.array(labels, object))
    bags: list[np.ndarray] = []
    for chunk in chunks(pa.array(texts, pa.large_string())):
        slots = [subwords(chunk, size) for size in SIZES]
        for i in range(chunk.n):
            x = np.concatenate([s[chunk.at[i] : chunk.at[i + 1]] for s in slots])
            bags.append(x[x < 1 << BUCKET_BITS])
    hidden = (1 << BUCKET_BITS) + 1
    emb = rng.normal(0, 0.1, (hidden, DIM)).astype(np.float32)
    emb[-1] = 0
    out = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    order = rng.permutation(len(bags))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    fit = fit if len(fit) else order
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for lo in range(0, len(fit), BATCH):
            ids = fit[lo : lo + BATCH]
            size = np.array([max(1, len(bags[i])) for i in ids])
            flat = np.concatenate([bags[i] if len(bags[i]) else np.array([hidden - 1], np.int32) for i in ids])
            h = np.add.reduceat(emb[flat], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None]
            p = _softmax(h @ out + bias)
            p[np.arange(len(ids)), y[ids]] -= 1
            p /= len(ids)
            rate = RATE * (1 - step / steps)
            back = (p @ out.T / size[:, None]).astype(np.float32)
            out -= (rate * h.T @ p).astype(np.float32)
            bias -= (rate * p.sum(0)).astype(np.float32)
            # each step touches a few thousand rows; a snippet's rows share one gradient
            np.subtract.at(emb, flat, np.repeat(rate * 20 * back, size, axis=0))
            emb[-1] = 0
            step += 1
    model = LanguageModel(langs, (emb @ out).astype(np.float32), bias, 1.0, 0.0)
    if len(held):
        z = np.array([model.table[bags[i]].mean(0) + bias if len(bags[i]) else bias for i in held])
        grid = np.geomspace(0.05, 5, 60)
        loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        top = np.sort(p.max(1))[::-1]
        right = (p.argmax(1) == y[held])[np.argsort(-p.max(1), kind="stable")]
        good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= ACCEPT)
        model.threshold = float(top[good[-1]]) if len(good) else 1.0
    return model


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(lang, snippet): per_lang snippets of each lang, or all it has. A text's snippets are its
    stretches of SNIPPET characters; each is drawn by its own hash, so that a language in few
    long documents gets as many as any other, and all are drawn of a language of few snippets."""
    size = F.ceil(F.length("text") / SNIPPET).cast("int")
    lang = F.col("lang").cast("string").alias("lang")
    parts = docs.filter("lang is not null and length(text) > 0").select("doc_id", lang, size.alias("n"), F.xxhash64("doc_id", "text").alias("key"), "text")
    total = materialize(parts.groupBy(F.col("lang").alias("t_lang")).agg(F.sum("n").alias("all")), "langs")
    share = 2 * F.lit(per_lang) / F.col("all")  # twice as many as wanted, on average
    places = F.sequence(F.lit(0), F.col("n") - 1)
    h = F.xxhash64("key", "i", F.lit("snippet"))
    drawn = parts.join(broadcast_if_small(total, 10_000), F.col("lang") == F.col("t_lang")).withColumn("i", F.explode(places)).withColumn("h", h)
    drawn = drawn.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    snippet = F.col("text").substr(F.col("i") * SNIPPET + 1, F.lit(SNIPPET)).alias("snippet")
    chosen = drawn.select("lang", "h", snippet).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("h", "snippet"))).alias("s"))
    return chosen.select("lang", F.explode(F.slice("s.snippet", 1, per_lang)).alias("snippet"))


def _predictor(model):
    def predict(batches):
        m = model.value
        for batch in batches:
            pred, score = [], []
            for chunk in chunks(batch.column("text"), CHUNK_BYTES // 2):
                p = _softmax(m.logits(chunk) / m.temperature)
                pred.append(p.argmax(1))
                score.append(p.max(1))
            pred = np.concatenate(pred) if pred else np.zeros(0, int)
            score = np.concatenate(score) if score else np.zeros(0)
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            lang = np.where(lettered, np.array([*m.langs, "und"], object)[pred], "und")
            score = np.where(lettered, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(lettered & (score >= m.threshold))],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    return predict


def identify(docs: DataFrame, learn: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, accepted (score at or above the
    calibrated threshold). learn: rows with text, lang and doc_id to fit on."""
    rows = training_rows(learn, per_lang).collect()
    rows.sort(key=lambda r: (r["lang"], r["snippet"]))
    model = train([r["snippet"] for r in rows], [r["lang"] for r in rows])
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered.alias("lettered"))
    if model is None:
        return src.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return src.mapInArrow(_predictor(shared), "doc_id long, lang_pred string, score double, accepted boolean")
