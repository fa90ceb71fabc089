"""Elements (filename, el_seq, page_number, category, text, y) to semantic chunks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.frames import written
from loomspark.functions.text import ends_sentence, is_list_item, stable_id, strip

#: Prefixes of page tags that are left out, labels, glossary keywords and page numbers.
EXCLUDE = ("unclassified", "restricted", "edition", "intentionally blank")
LABELS = ("unclassified", "restricted", "secret")
KEYWORDS = ("lexicon", "acronyms", "abbreviations", "terms", "definitions")
PAGE_NUMBER = r"^(?:\d+|p\d+|[ivxlcdmIVXLCDM]+|[A-Za-z0-9]+-[A-Za-z0-9]+)$"

#: Elements of a document that one row of arrays holds.
BLOCK = 4096


def first_chapter_page(elements: DataFrame, limit: int = 25) -> DataFrame:
    """filename, page: smallest page with "chapter 1" behind preface and contents, or null."""
    by_doc = W.partitionBy("filename")
    low = F.lower(strip("text"))
    stop = F.min(F.when(F.col("page_number") > limit, F.col("el_seq"))).over(by_doc)
    seen = elements.withColumn("stop", stop).filter("stop is null or el_seq <= stop").withColumn("low", low)
    last = lambda what: F.max(F.when(F.col("low") == what, F.struct("el_seq", "page_number"))).over(by_doc)["page_number"]
    seen = seen.withColumn("after", F.greatest(F.coalesce(last("preface"), F.lit(0)), F.coalesce(last("table of contents"), F.lit(0))))
    hit = F.when(F.col("low").contains("chapter 1") & (F.col("page_number") > F.col("after")), F.col("page_number"))
    return seen.groupBy("filename").agg(F.min(hit).alias("page"))


def skip_to_first_chapter(elements: DataFrame, limit: int = 25) -> DataFrame:
    """Elements from the first place at or behind the first chapter's page on."""
    page = first_chapter_page(elements, limit)
    at = F.min(F.when(F.col("page_number") >= F.coalesce("page", F.lit(0)), F.col("el_seq"))).over(W.partitionBy("filename"))
    return elements.join(page, "filename").withColumn("at", at).filter("el_seq >= at").drop("at", "page")


def page_tags(elements: DataFrame, exclude: Sequence[str] = EXCLUDE) -> DataFrame:
    """filename, page_number, tags: headers and titles of each page, in element order."""
    text = strip("text")
    keep = F.col("category").isin("Header", "Title") & (F.length(text) > 5)
    for x in exclude:
        keep &= ~F.lower(text).startswith(x)
    rows = elements.filter(keep).groupBy("filename", "page_number").agg(F.array_sort(F.collect_list(F.struct("el_seq", text.alias("text")))).alias("t"))
    return rows.select("filename", "page_number", F.col("t.text").alias("tags"))


def propagate_tags(tags: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Glossary pages keep only their keywords; a page that repeats a header of an earlier
    glossary page counts as "lexicon" and is one itself. The first page on which each header of a
    document is known is a least fixpoint: every round joins the headers that have become known
    with the later pages that bear them."""
    words = F.array(*[F.lit(k) for k in keywords])
    low = F.transform("tags", lambda t: F.lower(t))
    found = F.filter(words, lambda k: F.exists("low", lambda t: t.contains(k)))
    pages = written(tags.select("filename", "page_number", "tags", low.alias("low")).withColumn("found", found), "pages")
    heads = pages.select("filename", "page_number", F.explode("low").alias("h")).distinct()
    first = lambda some: some.groupBy("filename", "h").agg(F.min("page_number").alias("first"))
    glossary = written(pages.filter(F.size("found") > 0).select("filename", "page_number"), "glossary")
    known = written(first(heads.join(glossary, ["filename", "page_number"], "left_semi")), "known")
    told, news = None, known
    while True:
        # pages behind the first one of a header that is news
        hit = heads.join(news, ["filename", "h"]).filter("page_number > first").select("filename", "page_number").distinct()
        told = written(hit if told is None else told.unionByName(hit).distinct(), "told")
        fresh = told.join(glossary, ["filename", "page_number"], "left_anti")
        fresh = written(fresh, "glossary")
        if fresh.isEmpty():
            break
        glossary = glossary.unionByName(fresh)
        news = first(heads.join(fresh, ["filename", "page_number"], "left_semi"))
        news = written(news.join(known.withColumnRenamed("first", "was"), ["filename", "h"], "left").filter("was is null or first < was").drop("was"), "news")
        known = written(first(known.unionByName(news).withColumnRenamed("first", "page_number")), "known")
    out = pages.join(told.withColumn("told", F.lit(True)), ["filename", "page_number"], "left")
    kept = F.array_union("found", F.when(F.col("told"), F.array(F.lit("lexicon"))).otherwise(F.array().cast("array<string>")))
    return out.select("filename", "page_number", F.when(F.size(kept) > 0, F.array_sort(kept)).otherwise(F.col("tags")).alias("tags"))


def drop_headers(elements: DataFrame, bottom: float = 724, top: float = 52) -> DataFrame:
    """Without headers, classification labels, edition lines and page numbers."""
    text = strip("text")
    at_bottom = F.coalesce(F.col("y") >= bottom, F.lit(False))
    at_edge = at_bottom | F.coalesce(F.col("y") <= top, F.lit(False))
    gone = (F.col("category") == "Header") | (F.lower(text).isin(*LABELS) & at_edge) | (F.lower(text).startswith("edition") & at_bottom)
    return elements.filter(~F.coalesce(gone | (text.rlike(PAGE_NUMBER) & at_bottom), F.lit(False)))


# --- the size rule over blocks --------------------------------------------------------------

def _cuts(n: list[int], turns: list[bool], size: int, soft_max: int) -> list[int]:
    """Places in a block where a chunk begins, if size characters of one are open before it.
    turns[i]: a break before element i that does not depend on size."""
    out = []
    for i, (k, turn) in enumerate(zip(n, turns, strict=True)):
        if turn or size + k > soft_max:
            out.append(i)
            size = k
        else:
            size += k
    return out


def _summary(n: list[int], turns: list[bool], soft_max: int) -> tuple[list[int], list[int], list[int], int]:
    """What a block does with any open size before it (turns[0] left aside). More than limits[j]
    open characters make the first cut at its j-th possible place, or an earlier one; from there
    on exits[j] characters of the chunk begun at lasts[j] are open behind the block. The last of
    the places is one that cuts whatever is open (limit -1), if there is one. And the block's size."""
    after = [0] * (len(n) + 1)
    for i, k in enumerate(n):
        after[i + 1] = after[i] + k
    # from the last element back: where the next cut is if one is at i, and what follows from it
    exits, lasts, end = [0] * len(n), [0] * len(n), len(n)
    turn_at = [len(n)] * (len(n) + 1)
    for i in range(len(n) - 1, -1, -1):
        turn_at[i] = i if turns[i] and i else turn_at[i + 1]
    for i in range(len(n) - 1, -1, -1):
        # the first element that no longer fits behind i
        while end - 1 > i and after[end] - after[i] > soft_max and after[end - 1] - after[i] > soft_max:
            end -= 1
        stop = end if after[end] - after[i] <= soft_max else end - 1
        cut = min(max(stop, i + 1), turn_at[i + 1])
        exits[i], lasts[i] = (after[-1] - after[i], i) if cut >= len(n) else (exits[cut], lasts[cut])
    limits, places = [], []
    for i in range(len(n)):
        if i and turns[i]:
            limits.append(-1)
            places.append(i)
            break
        limit = soft_max - after[i + 1]
        if not limits or limit < limits[-1]:
            limits.append(max(limit, -1))
            places.append(i)
            if limit < 0:
                break
    return limits, [exits[p] for p in places], [lasts[p] for p in places], after[-1]


_INTS = T.ArrayType(T.IntegerType())


def _fields(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _summaries(soft_max: int):
    @F.pandas_udf(_fields(limits=_INTS, exits=_INTS, lasts=_INTS, total=T.LongType()))
    def run(n: pd.Series, turns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_summary(list(a), list(b), soft_max) for a, b in zip(n, turns, strict=True)], columns=["limits", "exits", "lasts", "total"])

    return run


_OPEN = T.ArrayType(_fields(size=T.LongType(), start_block=T.LongType(), start=T.IntegerType()))


@F.pandas_udf(_OPEN)
def _opened(blocks: pd.Series) -> pd.Series:
    """For each block of a document, and behind its last: the open size before it, and the block
    and place where that chunk began."""

    def one(rows) -> list[dict]:
        size, block, start, out = 0, None, None, []
        for r in rows:
            out.append({"size": size, "start_block": block, "start": start})
            s = r["s"]
            if r["turn"]:  # a cut at the first element: as if more was open than fits
                j = 0
            else:
                j = next((j for j, limit in enumerate(s["limits"]) if size > limit), None)
            if j is None:
                size += s["total"]
            else:
                size, block, start = s["exits"][j], r["block"], s["lasts"][j]
        return [*out, {"size": size, "start_block": block, "start": start}]

    return blocks.map(one)


def _starts(soft_max: int):
    @F.pandas_udf(_INTS)
    def run(n: pd.Series, turns: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([_cuts(a, b, int(s), soft_max) for a, b, s in zip(n, turns, size, strict=True)], dtype=object)

    return run


def chunk(elements: DataFrame, soft_max: int = 750, ignore_pages: bool = True, keep_tail: bool = False) -> DataFrame:
    """filename, chunk_seq, page_number, text. A document is cut into blocks of BLOCK elements,
    written once. A block's summary says for every size that may be open before it what is open
    behind it, so the blocks of a long document are stitched from small numbers, and each block
    is then cut and put together by itself; a chunk that goes on in the next blocks gets their
    first pieces. A document of one block needs none of this."""
    s = strip(F.coalesce("text", F.lit("")))
    e = elements.select("filename", "el_seq", "page_number", s.alias("s"))
    e = e.withColumn("closes", ends_sentence(F.col("s")) & ~is_list_item(F.col("s"))).withColumn("block", F.floor(F.col("el_seq") / BLOCK))
    rows = e.groupBy("filename", "block").agg(F.array_sort(F.collect_list(F.struct("el_seq", "page_number", "s", "closes"))).alias("r"))
    cut = F.col("r.closes")
    turn = lambda x, i: F.when(F.lit(False) if ignore_pages else F.coalesce(F.get("r", i - 1)["page_number"] != F.get("r", i)["page_number"], F.lit(False)), True).otherwise(F.coalesce(F.get(cut, i - 1), F.lit(False)))
    rows = rows.select(
        "filename", "block", F.col("r.el_seq").alias("el_seq"), F.col("r.page_number").alias("pages"), F.col("r.s").alias("s"),
        F.transform("r", lambda x: F.length(x["s"])).alias("n"), F.transform("r", turn).alias("turns"), F.element_at(cut, -1).alias("closes"),
    )
    rows = written(rows, "blocks")

    counts = rows.groupBy("filename").agg(F.count("*").alias("blocks"))
    many = written(counts.filter("blocks > 1").select("filename"), "blocks-many")
    long = rows.join(many, "filename", "left_semi")
    scalars = long.select("filename", "block", _summaries(soft_max)("n", "turns").alias("s"), "closes", F.get("pages", F.lit(0)).alias("first_page"), F.element_at("pages", -1).alias("last_page"))
    before = lambda c: F.lag(c).over(W.partitionBy("filename").orderBy("block"))
    turned = F.coalesce(before("closes"), F.lit(True))
    if not ignore_pages:
        turned |= F.coalesce(before("last_page") != F.col("first_page"), F.lit(False))
    stitched = scalars.withColumn("turn", turned).groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("block", "turn", "closes", "s"))).alias("b"))
    stitched = written(stitched.select("filename", "b.block", "b.turn", F.element_at("b.closes", -1).alias("closed"), _opened("b").alias("open")), "blocks-stitched")
    entries = stitched.select("filename", F.inline(F.arrays_zip("block", "turn", F.slice("open", 1, F.size("block")).alias("open")))).select("filename", "block", "turn", "open.*")
    tails = stitched.filter("not closed").select("filename", F.element_at("open", -1).alias("o")).select("filename", F.col("o.start_block").alias("block"), F.col("o.start").alias("start"))

    first = lambda turns, turn: F.transform(turns, lambda x, i: F.when(i == 0, turn).otherwise(x))
    words = lambda texts: F.filter(texts, lambda x: x != "")
    piece = lambda lo, hi: F.struct(F.get("el_seq", lo).alias("el_seq"), F.get("pages", lo).alias("page_number"), words(F.slice("s", lo + 1, hi - lo)).alias("words"))
    until = lambda i: F.coalesce(F.get("starts", i + 1), F.size("s"))
    pieces = F.transform("starts", lambda lo, i: piece(lo, until(i)))
    text = lambda p: F.struct(p["el_seq"].alias("el_seq"), p["page_number"].alias("page_number"), F.array_join(p["words"], "\n").alias("text"))
    full = lambda parts: F.filter(F.transform(parts, text), lambda p: p["text"] != "")

    short = rows.join(many, "filename", "left_anti")
    short = short.withColumn("starts", _starts(soft_max)("n", first(F.col("turns"), F.lit(True)), F.lit(0)))
    if not keep_tail:
        short = short.withColumn("starts_kept", F.when(F.col("closes"), F.size("starts")).otherwise(F.size("starts") - 1))
        one = short.select("filename", F.lit(0).cast("long").alias("before"), full(F.slice(pieces, F.lit(1), F.col("starts_kept"))).alias("chunks"))
    else:
        one = short.select("filename", F.lit(0).cast("long").alias("before"), full(pieces).alias("chunks"))

    long = long.join(entries, ["filename", "block"])
    long = long.withColumn("starts", _starts(soft_max)("n", first(F.col("turns"), F.col("turn")), F.col("size")))
    head = words(F.slice("s", 1, F.coalesce(F.get("starts", F.lit(0)), F.size("s"))))
    heads = long.select("filename", "start_block", F.struct("block", head.alias("w")).alias("h")).filter(F.size("h.w") > 0)
    heads = heads.groupBy("filename", F.col("start_block").alias("block")).agg(F.flatten(F.array_sort(F.collect_list("h"))["w"]).alias("more"))
    extra = heads.join(tails.withColumn("dropped", F.lit(True)), ["filename", "block"], "full") if not keep_tail else heads.withColumn("dropped", F.lit(None).cast("boolean"))
    own = long.withColumn("pieces", pieces).join(extra.select("filename", "block", "more", "dropped"), ["filename", "block"], "left")
    last = lambda p: F.struct(p["el_seq"].alias("el_seq"), p["page_number"].alias("page_number"), F.concat(p["words"], F.coalesce("more", F.array().cast("array<string>"))).alias("words"))
    end = F.size("pieces")
    own = own.withColumn("pieces", F.transform("pieces", lambda p, i: F.when(i + 1 == end, last(p)).otherwise(p)))
    own = own.select("filename", "block", full(F.slice("pieces", F.lit(1), F.when(F.col("dropped"), F.greatest(end - 1, F.lit(0))).otherwise(end))).alias("chunks"))
    own = written(own, "blocks-chunks")
    earlier = F.sum("count").over(W.partitionBy("filename").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    places = own.select("filename", "block", F.size("chunks").alias("count")).select("filename", "block", F.coalesce(earlier, F.lit(0)).alias("before"))
    out = one.unionByName(own.join(places, ["filename", "block"]).select("filename", "before", "chunks"))
    out = out.select("filename", "before", F.posexplode("chunks").alias("i", "c"))
    return out.select("filename", (F.col("before") + F.col("i")).cast("int").alias("chunk_seq"), "c.page_number", "c.text")


def attach_tags(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    out = chunks.join(tags.withColumnRenamed("tags", "page_tags"), ["filename", "page_number"], "left")
    return out.withColumn("page_tags", F.coalesce("page_tags", F.array().cast("array<string>")))


def chunk_documents(elements: DataFrame, limit: int = 25, soft_max: int = 750, ignore_pages: bool = True, keep_tail: bool = False) -> DataFrame:
    """The whole chain: skip, tags, propagation, header filter, fold, tags, ids."""
    body = written(skip_to_first_chapter(written(elements, "elements"), limit), "body")
    tags = propagate_tags(page_tags(body))
    out = attach_tags(chunk(drop_headers(body), soft_max, ignore_pages, keep_tail), tags)
    return out.withColumn("id", stable_id("filename", "chunk_seq", "text"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """n_chunks and n_files of every document and of all (null filename)."""
    each = chunks.groupBy("filename").agg(F.count("*").alias("n_chunks"), F.lit(1).cast("long").alias("n_files"))
    total = each.agg(F.lit(None).cast("string").alias("filename"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.count("*").alias("n_files"))
    return each.unionByName(total)
