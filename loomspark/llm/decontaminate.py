"""Operator 7, benchmark decontamination, in DataFrame operations only.

Item-sized windows of a document are compared with the benchmark items by exact
weighted-shingle similarity: the sum of minimum over the sum of maximum shingle counts. Their
SimHashes give the distance column only; at the threshold they lie too far apart to select by.

Windows are compared only where they can reach the threshold: for similarity t and m
shingles, at least 2mt / (1 + t) of a window's places must hold a shingle of some item of the
same size. A running count of such places gives these windows exactly, whatever the corpus.
A window and an item that share that many shingles also share one of their rarest
m - 2mt / (1 + t) + 1 each, in one order of all shingles: joining on these finds every pair.

A window may be clipped by the document's start or end and is scored by its real shingle count;
a document shorter than an item is such a window. An item of fewer words than a shingle is
looked up by shingles of its own length, in documents of any length.

Defined results: texts and items are compared by lower-cased words of letters and digits; null
or empty texts and items match nothing; rows equal in doc_id and text get equal results; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.common import broadcast_if_small, by_sorting, carried, doc_hash, materialize

SHINGLE, SIMILARITY = 5, 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), NOT_WORD), ""), lambda w: F.xxhash64(w))


def shingles(words: str, size: int) -> Column:
    """Hashes of all word shingles of an array of word hashes; a short one is one shingle."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(size)]))
    return F.when(n >= size, each).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))


def shingles_of(text: str, size: int) -> Column:
    """shingles() of a text column; the word hashes are bound once by a one-element transform."""
    def bound(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(n >= size, each).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))

    words = F.coalesce(word_hashes(F.col(text)), F.array().cast("array<long>"))
    return F.transform(F.array(words), bound)[0]


def simhash(h: str) -> list[Column]:
    """Aggregates: the majority of every bit over a group's hashes."""
    return [(2 * F.sum(F.shiftright(h, b).bitwiseAND(F.lit(1))) > F.count(h)).alias(f"b{b}") for b in range(64)]


def packed() -> Column:
    bits = [F.when(F.col(f"b{b}"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    out = bits[0]
    for x in bits[1:]:
        out = out.bitwiseOR(x)
    return out


def _fingerprint(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, fp of the groups of rows (keys, g: one shingle hash a row)."""
    return rows.groupBy(*keys).agg(*simhash("g")).select(*keys, packed().alias("fp"))


def _rarest(rows: DataFrame, owner: str, frequency: DataFrame, take: Column) -> DataFrame:
    """rows: owner, g, c (count of a shingle), and what take needs. The shingles of each owner
    that hold its take rarest ones, repeats counted."""
    order = W.partitionBy(owner).orderBy("f", "g")
    ranked = rows.join(broadcast_if_small(frequency, 1_000_000), "g", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    before = F.coalesce(F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).filter(F.col("before") < take)


def _need(m: Column, k: Column, similarity: float) -> Column:
    """Least number of shingles that m and k shingles of that similarity share."""
    return F.ceil((m + k) * (similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")


def windows_to_check(hits: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """hits: key, n, p (a place whose shingle occurs in an item of n words). The starts s and
    greatest lengths k of all windows with enough hits: key, n, m (places of an item), s, k. A
    window that the document's start or end clips needs fewer: it begins or ends at a hit, as
    others are less similar, and those that turn out not to be clipped are whole windows."""
    m = F.greatest(F.col("n") - (shingle - 1), F.lit(1)).cast("int")
    need = _need(m, m, similarity)
    doc = W.partitionBy("key", "n")
    ranked = hits.withColumn("r", F.row_number().over(doc.orderBy("p")))
    ranked = ranked.withColumn("hits", F.count("*").over(doc)).withColumn("end", F.max("p").over(doc))
    first = ranked.withColumn("m", m).withColumn("need", need).withColumn("at", F.col("r") + F.col("need") - 1)
    last = ranked.select(F.col("key").alias("l_key"), F.col("n").alias("l_n"), F.col("r").alias("l_r"), F.col("p").alias("l_p"))
    # the need-th hit from here on still lies in a window that starts here or a little before
    dense = first.join(by_sorting(last), (F.col("key") == F.col("l_key")) & (F.col("n") == F.col("l_n")) & (F.col("at") == F.col("l_r")))
    dense = dense.filter(F.col("l_p") - F.col("p") < F.col("m"))
    starts = F.sequence(F.greatest(F.col("p") - (F.col("m") - F.col("need")), F.lit(0)), F.col("p"))
    whole = dense.select("key", "n", "m", F.explode(starts).alias("s"), F.col("m").alias("k"))
    least = F.ceil(m * similarity - F.lit(1e-9)).cast("int")
    tail = ranked.filter((F.col("hits") - F.col("r") + 1 >= least) & (F.col("end") - F.col("p") < m))
    tail = tail.select("key", "n", m.alias("m"), F.col("p").alias("s"), m.alias("k"))
    head = ranked.filter((F.col("r") >= least) & (F.col("p") + 1 < m))
    head = head.select("key", "n", m.alias("m"), F.lit(0).alias("s"), (F.col("p") + 1).alias("k"))
    return whole.unionByName(tail).unionByName(head).distinct()


def short_items(docs: DataFrame, items: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h, item, n, s: the first place in each document of each item (item, n, w: its
    word hashes) of fewer words than a shingle; compared by shingles of the item's own length."""
    short = materialize(items.filter(F.col("n") < shingle).select("item", "n", F.xxhash64("w").alias("g")), "short-items")
    sizes = sorted(r["n"] for r in short.select("n").distinct().collect())
    key = ["doc_id", doc_hash().alias("h")]
    if not sizes:
        return docs.select(*key, F.lit(0).cast("long").alias("item"), F.lit(0).alias("n"), F.lit(0).alias("s")).limit(0)

    def runs(z: int) -> Column:
        starts = F.when(F.size("w") >= z, F.sequence(F.lit(0), F.size("w") - z)).otherwise(F.array().cast("array<int>"))
        run = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(z)])
        return F.transform(starts, lambda i: F.struct(F.lit(z).alias("n"), i.alias("s"), run(i).alias("g")))

    words = docs.select(*key, word_hashes(F.col("text")).alias("w"))
    at = words.select("doc_id", "h", F.explode(F.concat(*map(runs, sizes))).alias("e")).select("doc_id", "h", "e.*")
    found = at.join(broadcast_if_small(short, 1_000_000), ["n", "g"])
    return found.groupBy("doc_id", "h", "item", "n").agg(F.min("s").alias("s"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. One row a document (doc_id, h) and item
    that it holds: first_word and n_words of its best window, distance, similarity."""
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", "text").distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", word_hashes(F.col("text")).alias("w"))
    items = items.withColumn("n", F.size("w")).filter("n > 0")
    whole_items = materialize(items, "item-words")
    short = short_items(docs, whole_items, shingle).join(by_sorting(whole_items.select("item", "item_id")), "item")
    items = whole_items.filter(F.col("n") >= shingle)
    items = materialize(items.select("item", "item_id", "n", F.explode(shingles("w", shingle)).alias("g")), "items")
    sizes = materialize(items.select("g", "n").distinct(), "item-shingles")

    # A document's key is 64 bits of its doc_id and text; h, 64 of the text, guards it below.
    key = F.xxhash64("doc_id", "text")
    places = docs.select(key.alias("key"), F.posexplode(shingles_of("text", shingle)).alias("p", "g"))
    hits = places.join(broadcast_if_small(sizes, 1_000_000), "g").select("key", "n", "p")
    hits = materialize(hits.distinct(), "hits")
    todo = windows_to_check(hits, shingle, similarity)
    todo = todo.groupBy("key").agg(F.collect_list(F.struct("n", "s", "k", "m")).alias("todo")).withColumnRenamed("key", "t_key")
    todo = materialize(todo, "windows-todo")
    held = docs.join(broadcast_if_small(todo, 500_000, F.size("todo")), key == F.col("t_key"))
    held = held.select("doc_id", doc_hash().alias("h"), shingles_of("text", shingle).alias("g"), "todo")
    cut = F.transform("todo", lambda t: F.struct(t["n"].alias("n"), t["s"].alias("s"), F.slice("g", t["s"] + 1, t["k"]).alias("g"), t["m"].alias("m")))
    enough = F.filter(cut, lambda t: F.size(t["g"]) >= t["m"] * similarity - 1e-9)
    windows = held.select("doc_id", "h", F.explode(enough).alias("t")).distinct()
    windows = materialize(windows.select("doc_id", "h", F.xxhash64("t.n", F.sort_array("t.g")).alias("win"), "t.n", "t.s", "t.m", F.size("t.g").alias("k"), "t.g"), "windows")

    # equal windows and equal items are compared once
    shown = windows.select("win", "n", "k", "g").dropDuplicates(["win"])
    shown = shown.select("win", "n", "k", F.explode("g").alias("g"))
    ours = materialize(shown.groupBy("win", "n", "k", "g").agg(F.count("*").alias("c")), "window-shingles")
    each = items.groupBy("item", "n").agg(F.sort_array(F.collect_list("g")).alias("all"))
    twins = materialize(each.select("item", "n", F.xxhash64("n", "all").alias("like")), "item-likes")
    one = twins.groupBy("like").agg(F.min("item").alias("item"))
    theirs = items.join(broadcast_if_small(one), "item").groupBy("like", "n", "g").agg(F.count("*").alias("c"))
    theirs = materialize(theirs, "like-shingles")
    frequency = materialize(theirs.groupBy("g").agg(F.count("*").alias("f")), "shingle-frequency")
    m = F.greatest(F.col("n") - (shingle - 1), F.lit(1))
    least = F.ceil(m * similarity - F.lit(1e-9)).cast("int")  # shared with the shortest window
    ask = _rarest(ours, "win", frequency, F.col("k") - _need(m, F.col("k"), similarity) + 1).select("win", "n", "g")
    have = _rarest(theirs, "like", frequency, m - least + 1).select("like", "n", "g")
    found = materialize(ask.join(by_sorting(have), ["n", "g"]).select("win", "like").distinct(), "window-pairs")

    counts = theirs.select("like", "g", F.col("c").alias("ic"))
    shared = found.join(by_sorting(ours.select("win", "g", "c")), "win").join(by_sorting(counts), ["like", "g"]).groupBy("win", "like").agg(F.sum(F.least("c", "ic")).alias("shared"))
    scored = shared.join(by_sorting(windows.select("win", "doc_id", "h", "n", "s", "m", "k")), "win")
    scored = scored.withColumn("similarity", F.col("shared") / (F.col("m") + F.col("k") - F.col("shared"))).filter(F.col("similarity") >= similarity)
    item_fp = _fingerprint(items, "item", "item_id", "n").withColumnRenamed("fp", "item_fp")
    scored = scored.join(by_sorting(twins.select("like", "item")), "like").join(by_sorting(_fingerprint(shown, "win")), "win").join(by_sorting(item_fp.select("item", "item_fp")), "item")
    scored = scored.withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    # a clipped window counts where no whole one is similar enough
    best = F.max(F.struct((F.col("k") == F.col("m")).alias("whole"), "similarity", (-F.col("s")).alias("back"), "k", "distance")).alias("best")
    names = item_fp.select("item", "item_id")
    long = (
        scored.groupBy("doc_id", "h", "item")
        .agg(best)
        .join(by_sorting(names), "item")
        .select(
            "doc_id",
            "h",
            "item_id",
            (-F.col("best.back")).cast("long").alias("first_word"),
            (F.col("best.k") + F.lit(shingle - 1)).cast("long").alias("n_words"),
            F.col("best.distance").cast("int").alias("distance"),
            F.col("best.similarity").alias("similarity"),
        )
    )
    own = [F.col("s").cast("long").alias("first_word"), F.col("n").cast("long").alias("n_words"), F.lit(0).alias("distance"), F.lit(1.0).alias("similarity")]
    return long.unionByName(short.select("doc_id", "h", "item_id", *own))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    found = contaminated(docs.withColumn("doc_id", F.col("doc_id").cast("long")), benchmark)
    bad = materialize(found.select(F.col("doc_id").alias("b_id"), F.col("h").alias("b_h")).distinct(), "leaks")
    return carried(docs).join(broadcast_if_small(bad), F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_h")), "left_anti").select("row.*")
