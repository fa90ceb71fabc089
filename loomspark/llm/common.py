"""Shared pieces of the corpus operators: tables, written intermediates, size-checked
broadcasts, and vectorised byte-level tokenisation for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Only where it is
    unset on one machine (tests) a temporary folder takes its place; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives lost
    executors, and gives later joins true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_sorting(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles and sorts. Left to itself, Spark takes the bytes of the
    files for the size, also behind an explode or an aggregate over one, and so collects for a
    broadcast what the driver cannot hold."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, size: Column | None = None) -> DataFrame:
    """Broadcast a written frame of narrow rows if it has at most max_rows rows; beyond that
    the join shuffles. Rows that hold arrays count as size says."""
    if size is not None:
        few = df.agg(F.coalesce(F.sum(size + 1), F.lit(0))).first()[0] <= max_rows
    else:
        few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else by_sorting(df)


def doc_hash(text: str | Column = "text") -> Column:
    """With doc_id it names a row by content, so recomputed tasks agree on it. Rows equal in
    doc_id and text are one document."""
    return F.xxhash64(text)


#: Rows of the word table of maybe_in, 64 bits each.
BITMAP_WORDS = 1 << 18


def maybe_in(df: DataFrame, h: str, ids: DataFrame) -> DataFrame:
    """df with a column maybe: false where h is certainly not among the single long column of
    ids. The broadcast side is a bitmap of at most BITMAP_WORDS rows, whatever the size of ids;
    it spares rows a shuffle and never decides."""
    bit = F.pmod(F.col(ids.columns[0]), F.lit(64 * BITMAP_WORDS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("bm_word"))
    words = materialize(words.agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bm_bits")), "bitmap")
    own = F.pmod(F.col(h), F.lit(64 * BITMAP_WORDS))
    out = df.withColumn("bm_own", own).join(F.broadcast(words), F.shiftright("bm_own", 6) == F.col("bm_word"), "left")
    hit = F.expr("coalesce(getbit(bm_bits, int(bm_own & 63)) = 1, false)")
    return out.withColumn("maybe", hit).drop("bm_own", "bm_word", "bm_bits")


#: A key with more than 1 / HEAVY of all rows, and more than FEW, is heavy, so there are at most
#: HEAVY such keys; each is spread over SALTS parts.
HEAVY, FEW, SALTS = 1024, 1000, 128


def join_counted(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, spread: Column, how: str = "inner") -> DataFrame:
    """left joined to right on keys. right holds each key once, with its number of rows of left in
    count (dropped), and is cheap to read again. Heavy keys are salted by spread, so no key meets in one task."""
    total = right.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = (F.col(count) * HEAVY > total) & (F.col(count) > FEW)
    heavy = right.filter(hot).select(*keys, F.lit(True).alias("is_heavy"))
    salt = F.when(F.col("is_heavy"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    left = left.join(F.broadcast(heavy), list(keys), "left").withColumn("salt", salt).drop("is_heavy")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("salt", F.explode(salts)).drop(count)
    return left.join(by_sorting(right), [*keys, "salt"], how).drop("salt")


def carried(docs: DataFrame, *extra: Column) -> DataFrame:
    """All columns of docs as one struct `row`, so that no name of theirs can clash with ours,
    beside doc_id (long), text, h and what extra computes from docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), doc_hash().alias("h"), *extra)


#: Separators of plain words, the complement of the class [^\\x20\\x09-\\x0D].
BLANKS = r"[\x20\x09-\x0D]+"


def count_words(text: str | Column = "text", separator: str = BLANKS) -> Column:
    """Number of maximal runs between separators; null has none. Splitting is several times
    faster than regexp_count."""
    return F.coalesce(F.size(F.array_remove(F.split(text, separator), "")).cast("long"), F.lit(0).cast("long"))


# --- bytes, words and hashes in numpy -------------------------------------------------------

_MUL = 0x9E3779B97F4A7C15
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M^i and M^-i modulo 2^64 for i in 0..n."""
    if len(_POW.get("p", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        p = np.full(size, _MUL, np.uint64)
        q = np.full(size, pow(_MUL, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _POW["p"], _POW["q"] = np.cumprod(p), np.cumprod(q)
    return _POW["p"][: n + 1], _POW["q"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Prefix sums P with hash(b[s:e]) = (P[e] - P[s]) * M^-s."""
    out = np.empty(len(b) + 1, np.uint64)
    out[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(len(b))[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of byte spans."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix) - 1)[1][start])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Chunk:
    """Some whole texts laid end to end: b holds the bytes, at[i]:at[i+1] are text i's, and
    rows are their positions in the batch."""

    def __init__(self, b: np.ndarray, at: np.ndarray, first: int):
        self.b, self.at, self.first, self.n = b, at, first, len(at) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all maximal runs outside the six ASCII blanks."""
        w = ~_SPACE[self.b]
        n = len(w)
        cut = np.zeros(n + 1, bool)
        cut[self.at] = True
        left = np.empty(n, bool)
        left[:1] = True
        left[1:] = ~w[:-1]
        right = np.empty(n, bool)
        right[-1:] = True
        right[:-1] = ~w[1:]
        return np.flatnonzero(w & (left | cut[:-1])), np.flatnonzero(w & (right | cut[1:])) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of all newline-split lines, empty ones included; an
        empty text has one empty line."""
        nl = np.flatnonzero(self.b == 10)
        starts = np.concatenate([self.at[:-1], nl + 1])
        ends = np.concatenate([nl, self.at[1:]])
        owner = np.concatenate([np.arange(self.n), np.searchsorted(self.at, nl, "right") - 1])
        order = np.lexsort((starts, owner))
        owner_end = np.concatenate([np.searchsorted(self.at, nl, "right") - 1, np.arange(self.n)])
        return starts[order], ends[np.lexsort((ends, owner_end))], owner[order]

    def bounds(self, starts: np.ndarray) -> np.ndarray:
        """Index of the first of the sorted starts in each text, and one past the last text."""
        return np.searchsorted(starts, self.at)


def chunks(text: pa.Array, limit: int = CHUNK_BYTES):
    """Cut an Arrow string column into Chunks of whole texts; null counts as empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    _, offsets, data = text.buffers()
    n = len(text)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield Chunk(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo)
        lo = hi


def per_text(values: np.ndarray, bounds: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], empty slices give 0."""
    total = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=total[1:], dtype=dtype)
    return total[bounds[1:]] - total[bounds[:-1]]
