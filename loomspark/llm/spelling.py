"""Groups spelling variants: words one edit apart, found through Bloom filters.

Spark counts the vocabulary. Every word of it gets a 64-bit hash that is a polynomial in its code
points, so that the hash of an edited word follows from the word's own prefix sums, whatever the
length. The hashes fill Bloom filters, one shard a word length, whose blocks are machine words:
a probe is one read. The filters have a fixed largest size and are broadcast. Each word probes its
deletions and its replacements by higher letters (insertions are the deletions of the other
word); only edits that the filters let through are shuffled to an exact join with the vocabulary,
where the edited word itself is compared, so neither false positives nor equal hashes remain.

Texts that are null or hold no run of letters have no words; a null doc_id counts as the empty
string. Ties between forms go to the smaller word in code-point order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import materialize, mix, powers

#: What separates runs of letters, and the letters left once A-Z are lower-cased.
NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lengths from SHARDS on share one shard; 64-bit blocks of all filters together, at most, and
#: of one filter, at least; words a block is made for.
SHARDS, MOST_BLOCKS, LEAST_BLOCKS, PER_BLOCK = 64, 1 << 20, 1 << 8, 4
#: Edits probed at once inside a task.
PROBES = 1 << 20


def damaged_runs(docs: DataFrame, every: int = 199) -> DataFrame:
    """word: every run of letters, A-Z lower-cased; where every divides the crc32 of
    `<doc_id>:<run>`, without its code point number crc32 % length."""
    low = F.translate("text", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.split(low, NOT_LETTERS)).alias("run")).filter("run <> ''")
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    cut = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    return runs.select(F.when(h % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """word, n: words long and frequent enough, and how often each occurs."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the words of each length, and their code points as one matrix."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, points[at[rows][:, None] + np.arange(size)]


def _hashed(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums ^ np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64)))


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.zeros(batch.num_rows, np.uint64)
        for rows, c in _by_length(batch.column("word")):
            h[rows] = _hashed((c * powers(c.shape[1])[0][:-1]).sum(axis=1, dtype=np.uint64), c.shape[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=[*batch.schema.names, "h"])


class Filters:
    """The filters of all shards, end to end; first[s] and size[s] (a power of two) are the
    blocks of shard s. Of a hash, the low four times six bits choose the bits of a block, those
    above choose the block."""

    def __init__(self, counts: dict[int, int]):
        sizes = {s: 1 << max(LEAST_BLOCKS.bit_length() - 1, (max(n, 1) // PER_BLOCK).bit_length()) for s, n in counts.items()}
        while sum(sizes.values()) > MOST_BLOCKS and max(sizes.values()) > LEAST_BLOCKS:
            sizes = {s: max(LEAST_BLOCKS, n // 2) for s, n in sizes.items()}
        self.size = np.array([sizes.get(s, 0) for s in range(SHARDS + 1)], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bits = np.zeros(int(self.size.sum()), np.uint64)

    def slot(self, h: Column, shard: Column) -> Column:
        """The block of a hash, as a Spark expression."""
        of = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), shard + 1)
        return of(self.first) + F.shiftrightunsigned(h, 24).bitwiseAND(of(self.size) - 1)

    def fill(self, words: DataFrame) -> Filters:
        """Spark joins the bits of each block; the driver gets at most MOST_BLOCKS of them."""
        shard = F.least(F.length("word"), F.lit(SHARDS))
        bits = F.expr(" | ".join(f"shiftleft(1L, int(shiftrightunsigned(h, {6 * i}) & 63))" for i in range(4)))
        blocks = words.groupBy(self.slot(F.col("h"), shard).alias("slot")).agg(F.bit_or(bits).alias("bits")).toArrow()
        self.bits[blocks["slot"].to_numpy()] = blocks["bits"].to_numpy().view(np.uint64)
        return self

    def holds(self, h: np.ndarray, length: int) -> np.ndarray:
        s = min(length, SHARDS)
        if not self.size[s]:
            return np.zeros(h.shape, bool)
        block = self.bits[self.first[s] + ((h >> np.uint64(24)) & np.uint64(self.size[s] - 1)).astype(np.int64)]
        one, low = np.uint64(1), np.uint64(63)
        want = (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low)) | (one << ((h >> np.uint64(18)) & low))
        return block & want == want


def _filters(words: DataFrame) -> Filters:
    counts = words.groupBy(F.least(F.length("word"), F.lit(SHARDS)).alias("s")).count()
    return Filters({r["s"]: r["count"] for r in counts.collect()}).fill(words)


_EDITS = "word string, n long, place int, letter int, h long, length int"


def edits(c: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, ...]]:
    """c: code points of words of one length. Word, place, letter (-1: deleted), hash and length
    of the deletions and upward replacements that the filters let through. Of equal
    neighbours only the first is deleted, so no edit is told twice."""
    size = c.shape[1]
    up = powers(size)[0]
    for lo in range(0, len(c), max(1, PROBES // size)):
        part = c[lo : lo + max(1, PROBES // size)]
        terms = part * up[:-1]
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
        lower = np.zeros_like(terms)
        lower[:, 1:] = part[:, 1:] * up[:-2]
        after = lower.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(lower, axis=1, dtype=np.uint64)
        h = _hashed(before + after, size - 1)
        first = np.ones(part.shape, bool)
        first[:, 1:] = part[:, 1:] != part[:, :-1]
        w, p = np.nonzero(first & filters.holds(h, size - 1))
        yield w + lo, p, np.full(len(w), -1), h[w, p], np.full(len(w), size - 1)
        for letter in LETTERS:
            h = _hashed(whole + (letter - part) * up[:-1], size)
            w, p = np.nonzero((part < letter) & filters.holds(h, size))
            yield w + lo, p, np.full(len(w), int(letter)), h[w, p], np.full(len(w), size)


def _probe(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in _by_length(batch.column("word")):
                for w, place, letter, h, length in edits(c, shared.value):
                    if len(w):
                        at = pa.array(rows[w])
                        cols = [batch.column("word").take(at), batch.column("n").take(at)]
                        cols += [pa.array(x.astype(np.int32)) for x in (place, letter)] + [pa.array(h.view(np.int64)), pa.array(length.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(cols, names=["word", "n", "place", "letter", "h", "length"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """words: word, n. word, n, near, near_n: all pairs of words one edit apart, both ways."""
    known = materialize(words.mapInArrow(_word_hashes, "word string, n long, h long"), "vocabulary")
    shared = words.sparkSession.sparkContext.broadcast(_filters(known))
    probes = known.select("word", "n").mapInArrow(_probe(shared), _EDITS)
    target = known.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "h", F.length("word").alias("length"))
    letter = F.when(F.col("letter") < 0, F.lit("")).otherwise(F.char(F.col("letter")))
    edited = F.concat(F.expr("substring(word, 1, place)"), letter, F.expr("substring(word, place + 2)"))
    pairs = materialize(probes.join(target, ["h", "length"]).filter(edited == F.col("near")).select("word", "n", "near", "near_n"), "near")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form. Forms grow in frequency, so there are no cycles;
    each round doubles the way, so the rounds are the logarithm of the longest way."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = materialize(at.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """words: word, n. word, form, root, n, n_near, form_n: the form is the most frequent near
    word, if at least ratio times as frequent; the root is where the forms lead."""
    words = materialize(words, "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    fits = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    out = rows.join(_roots(rows.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
