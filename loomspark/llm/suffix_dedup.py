"""Operator 10, repeated windows by depth-limited radix passes over suffixes.

A suffix matters only through its first LENGTH bytes, its window. Passes from the most
significant digit on split the suffixes into groups with equal digits; groups of one leave
after every pass, and groups that are still equal at full depth are exactly the repeated
windows. Digits are 64-bit hashes, two of them for every verdict.

Which suffixes enter is decided without loss: a window's anchor is its smallest hashed string
of DIGIT bytes, so equal windows have equal anchors at equal offsets, and consecutive windows
mostly share one. Pass 1 groups anchors instead of suffixes (about 2 / (LENGTH - DIGIT) of
them). Pass 2 groups the anchors that occur twice by the union of all their windows: where
that is repeated, all these windows are. Pass 3 groups single windows, only for the other
anchors whose string repeats, against one representative of each equal union: the bytes of
such unions meet by anchor string, in one task up to GROUP of them and over all tasks beyond.

Defined results: null and empty texts have no bytes; texts shorter than a window lose nothing;
rows equal in doc_id and text are two occurrences; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import broadcast_if_small, by_sorting, carried, chunks, doc_hash, join_counted, materialize, maybe_in, mix, powers, prefix_hash, span_hash

LENGTH, DIGIT = 200, 50
#: A string with more different unions than this has its windows grouped by Spark instead of
#: within one task.
GROUP = 4096


def anchors(chunk, length: int, digit: int) -> dict[str, np.ndarray]:
    """Runs of windows with the same anchor: text, key (hash of the anchor string), ctx (hash
    of all their bytes), lo and hi (first and last window start within the text)."""
    b, at = chunk.b, chunk.at
    n, w = len(b), length - digit + 1
    if n < length:
        return {k: np.zeros(0, np.int64) for k in ("text", "key", "ctx", "lo", "hi")}
    prefix = prefix_hash(b)
    grams = mix((prefix[digit:] - prefix[:-digit]) * powers(n)[1][: n - digit + 1])
    order = np.argsort(grams, kind="stable")  # of equal strings the first is smaller
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    pad = -len(rank) % w
    blocks = np.concatenate([rank, np.full(pad, len(grams))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    anchor = order[np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])]
    # windows must end within their text
    cross = np.zeros(n + 1, np.int64)
    np.add.at(cross, np.maximum(at[1:] - length + 1, at[:-1]), 1)
    np.subtract.at(cross, at[1:], 1)
    valid = np.cumsum(cross)[:windows] == 0
    change = np.ones(windows, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(change & valid)
    last = np.ones(windows, bool)
    last[:-1] = (anchor[1:] != anchor[:-1]) | ~valid[1:]
    hi = np.flatnonzero(last & valid)
    text = np.searchsorted(at, lo, "right") - 1
    return {
        "text": text,
        "key": grams[anchor[lo]].view(np.int64),
        "ctx": span_hash(prefix, lo, hi + length).view(np.int64),
        "lo": lo - at[text],
        "hi": hi - at[text],
    }


def _anchor_rows(length: int, digit: int):
    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), 1 << 18):
                a = anchors(chunk, length, digit)
                rows = pa.array(a["text"] + chunk.first)
                cols = [batch.column("doc_id").take(rows), batch.column("h").take(rows)]
                cols += [pa.array(a[k]) for k in ("key", "ctx")] + [pa.array(a[k].astype(np.int32)) for k in ("lo", "hi")]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "key", "ctx", "lo", "hi"])

    return run


_ANCHORS = "doc_id long, h long, key long, ctx long, lo int, hi int"


def _union_bytes(length: int):
    """The bytes of the listed runs of each text: doc_id, h, key, large, lo, b."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("row", "key", "large", "lo", "b")}
            for i, (t, runs) in enumerate(zip(batch.column("text"), batch.column("runs"), strict=True)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                for r in runs.as_py():
                    out["row"].append(i)
                    out["key"].append(r["key"])
                    out["large"].append(r["large"])
                    out["lo"].append(r["lo"])
                    out["b"].append(raw[r["lo"] : r["hi"] + length])
            rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("h").take(rows), pa.array(out["key"], pa.int64()), pa.array(out["large"], pa.bool_()), pa.array(out["lo"], pa.int32()), pa.array(out["b"], pa.binary())],
                names=["doc_id", "h", "key", "large", "lo", "b"],
            )

    return run


def _windows_of(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start within the row and digit of all windows of the batch's byte strings."""
    b = pa.array(batch.column("b").to_pylist(), pa.large_binary())
    at = np.frombuffer(b.buffers()[1], np.int64)[: len(b) + 1]
    raw = np.frombuffer(b.buffers()[2], np.uint8)[: at[-1]]
    count = np.maximum(np.diff(at) - length + 1, 0)
    row = np.repeat(np.arange(len(b)), count)
    start = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    s = start + at[:-1][row]
    return row, start, span_hash(prefix_hash(raw), s, s + length)


_SPAN = "doc_id long, h long, lo int, hi int"


def _spans(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive window starts as spans of their texts."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    rows = pa.array(row[first])
    base = batch.column("lo").to_numpy(zero_copy_only=False)[row[first]]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(rows), batch.column("h").take(rows), pa.array((base + start[first]).astype(np.int32)), pa.array((base + start[last]).astype(np.int32))],
        names=["doc_id", "h", "lo", "hi"],
    )


def _group_in_task(length: int):
    """Spans of windows that occur twice under their key. Rows come sorted by key; those of the
    last key wait for the next batch."""

    def repeated(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, digit = _windows_of(batch, length)
        key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        full = mix(digit ^ mix(key)[row])
        order = np.argsort(full, kind="stable")
        same = full[order][1:] == full[order][:-1]
        twice = np.zeros(len(full), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        return _spans(batch, row[twice], start[twice])

    def run(batches):
        wait = None
        for batch in batches:
            if wait is not None:
                batch = pa.concat_batches([wait, batch])
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
            wait = batch.slice(int(edges[-2])) if len(edges) > 1 else batch
            done, lo = int(edges[-2]) if len(edges) > 1 else 0, 0
            while lo < done:  # whole keys, about a thousand strings at a time
                hi = int(edges[min(np.searchsorted(edges, lo + 1000), len(edges) - 2)])
                yield repeated(batch.slice(lo, hi - lo))
                lo = hi
        if wait is not None and wait.num_rows:
            yield repeated(wait)

    return run


def _window_rows(length: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                row, start, digit = _windows_of(part, length)
                rows = pa.array(row)
                s = part.column("lo").to_numpy(zero_copy_only=False)[row] + start
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("h").take(rows), part.column("key").take(rows), pa.array(digit.view(np.int64)), pa.array(s.astype(np.int32))],
                    names=["doc_id", "h", "key", "digit", "s"],
                )

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT, group: int = GROUP) -> DataFrame:
    """doc_id, h, spans (array of lo, hi: first and last start of repeated windows, in bytes)
    for every document with a repeated window."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", doc_hash().alias("h"))
    first = src.mapInArrow(_anchor_rows(length, digit), _ANCHORS)
    # Pass 1: anchor strings that occur twice. Counting combines on the map side, so a string
    # in a third of all documents is one row a task; the join back salts such strings.
    keys = first.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    keys = materialize(keys.filter("n > 1").select("key", "n", (F.col("c0") != F.col("c1")).alias("mixed")), "suffix-keys")
    twice = maybe_in(first, "key", keys.select("key")).filter("maybe").drop("maybe")
    twice = materialize(join_counted(twice, keys, ["key"], "n", F.struct("doc_id", "h", "lo")), "suffix-1")
    # Pass 2: unions of windows that occur twice.
    mixed = twice.filter("mixed")
    ref = F.struct("doc_id", "h", "lo", "hi")
    unions = mixed.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(ref).alias("one"))
    unions = materialize(unions, "suffix-2")
    alone = unions.filter("n = 1").select("key", "ctx")
    several = mixed.join(by_sorting(alone), ["key", "ctx"], "left_anti")
    whole = twice.filter("not mixed").select("doc_id", "h", "lo", "hi").unionByName(several.select("doc_id", "h", "lo", "hi"))
    # Pass 3: windows of the rest, where some union of the string occurs once.
    open_keys = unions.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("m"))
    open_keys = open_keys.filter("least = 1 and m > 1").select("key", (F.col("m") > group).alias("large"))
    rest = unions.join(by_sorting(open_keys), "key").select("key", "large", "one.*")
    rest = rest.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi", "key", "large")).alias("runs"))
    rest = materialize(rest.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), "runs"), "suffix-rest")
    texts = maybe_in(src, "h", rest.select("r_h")).filter("maybe")
    joined = texts.join(broadcast_if_small(rest, size=F.size("runs")), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")))
    strings = joined.select("doc_id", "h", "text", "runs").mapInArrow(_union_bytes(length), "doc_id long, h long, key long, large boolean, lo int, b binary")
    strings = materialize(strings, "suffix-3")
    small = strings.filter("not large").repartition("key").sortWithinPartitions("key").drop("large").mapInArrow(_group_in_task(length), _SPAN)
    windows = strings.filter("large").mapInArrow(_window_rows(length), "doc_id long, h long, key long, digit long, s int")
    equal = windows.groupBy("key", "digit").agg(F.count("*").alias("n")).filter("n > 1").select("key", "digit")
    large = windows.join(by_sorting(equal), ["key", "digit"], "left_semi").select("doc_id", "h", F.col("s").alias("lo"), F.col("s").alias("hi"))
    spans = whole.unionByName(small).unionByName(large)
    return spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cut(text: str | None, spans: list | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that stay and the maximal removed runs (start, end)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not spans:
        return raw, []
    cover = np.zeros(len(raw) + 1, np.int64)
    np.add.at(cover, [s["lo"] for s in spans], 1)
    np.subtract.at(cover, [s["hi"] + length for s in spans], 1)
    gone = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), runs


def _digest(length: int):
    def run(batches):
        for batch in batches:
            out = [cut(t.as_py(), s.as_py(), length) for t, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
            removed = [sum(b - a for a, b in runs) for _, runs in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(kept) + r for (kept, _), r in zip(out, removed, strict=True)], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array([len(runs) for _, runs in out], pa.int64()),
                    pa.array([hashlib.sha256(kept).hexdigest() for kept, _ in out], pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def _cleaned(length: int):
    def run(batches):
        for batch in batches:
            text = [cut(t.as_py(), s.as_py(), length)[0].decode("utf-8", "ignore") for t, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], names=["row", "text"])

    return run


def _with_spans(own: DataFrame, length: int, digit: int) -> tuple[DataFrame, DataFrame]:
    """own (carried docs): the rows without spans, and the others with theirs."""
    spans = repeated_spans(own.select("doc_id", "text"), length, digit)
    spans = materialize(spans.withColumnRenamed("doc_id", "s_id").withColumnRenamed("h", "s_h"), "suffix-spans")
    named = maybe_in(own, "h", spans.select("s_h"))
    on = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h"))
    more = named.filter("maybe").join(broadcast_if_small(spans, size=F.size("spans")), on, "left")
    plain = named.filter("not maybe").select("row", "doc_id", "text").unionByName(more.filter("spans is null").select("row", "doc_id", "text"))
    return plain, more.filter("spans is not null").select("row", "doc_id", "text", "spans")


def removal_digest(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    plain, some = _with_spans(carried(docs.select("doc_id", "text")), length, digit)
    none = F.lit(0).cast("long")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    whole = plain.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return whole.unionByName(some.select("doc_id", "text", "spans").mapInArrow(_digest(length), schema))


def remove_repeats(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT) -> DataFrame:
    """docs with the repeated bytes cut out of text; half characters at a cut are dropped."""
    plain, some = _with_spans(carried(docs), length, digit)
    schema = T.StructType([some.schema["row"], T.StructField("text", T.StringType())])
    out = plain.select("row", "text").unionByName(some.select("row", "text", "spans").mapInArrow(_cleaned(length), schema))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
