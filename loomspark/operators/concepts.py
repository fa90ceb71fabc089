"""Chunks to concepts: prompts, pluggable extraction, parsing of responses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import stable_id, strip
from loomspark.operators import calls

RESPONSE = "array<struct<term:string,definition:string>>"


# Fixed value: what a model is sent for a chunk.
TEMPLATE = "{'text': {text}, 'metadata':{'page_tags': {page_tags}}}"


def prompts(chunks: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Adds prompt: the template with {text} and {page_tags} filled in; the tags are a bracketed
    list of quoted strings."""
    tags = F.transform(F.coalesce("page_tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("'"), t, F.lit("'")))
    values = {"{text}": F.coalesce("text", F.lit("")), "{page_tags}": F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]"))}
    parts = [values[p] if p in values else F.lit(p) for p in re.split(r"(\{text\}|\{page_tags\})", template) if p]
    return chunks.withColumn("prompt", F.concat(*parts))


def extract(chunks: DataFrame, model: calls.Model, store: str, name: str, template: str = TEMPLATE, clients: int = 8, slices: int = 8) -> DataFrame:
    """filename, chunk_id, chunk_seq, response: the model's answers to the chunks' prompts, by way
    of the store (calls.answered): equal prompts are asked once, a job run again asks the rest."""
    asked = prompts(chunks, template).select("filename", F.col("id").alias("chunk_id"), F.col("chunk_seq").cast("long").alias("chunk_seq"), "prompt")
    return calls.answered(asked, "prompt", model, store, name, clients=clients, slices=slices).drop("prompt").withColumnRenamed("answer", "response")


#: Sentences that define a term of up to four words, and the definition: with "is" or "are" and an
#: article; with a verb of defining; on glossary pages without a verb, the article capitalised;
#: and with "is" or "are" and any definition where the sentence before is the term itself.
TERM = r"^(\S+(?: \S+){0,3}?) "
IS_A = TERM + r"(?:is|are) ((?:the|a|an|any) .+?)[.!?]*$"
MEANS = TERM + r"(?:means|refers to|is defined as|are defined as) (.+?)[.!?]*$"
GLOSSARY = TERM + r"((?:The|A|An|Any) .+?)[.!?]*$"
NAMED = TERM + r"(?:is|are) (.+?)[.!?]*$"
#: Page tags of glossary pages: the keywords that mark one.
GLOSSARY_TAGS = ("lexicon", "acronyms", "abbreviations", "terms", "definitions")


def rule_concepts(chunks: DataFrame) -> DataFrame:
    """filename, chunk_seq, page_number, item_seq (sentence), name, definition: the explicit
    definitions in a chunk's sentences, in the source's words, first letters capitalised and the
    closing mark left out. chunks without page_tags have no glossary pages."""
    tagged = F.lit(False)
    if "page_tags" in chunks.columns:
        tagged = F.exists(F.coalesce("page_tags", F.array().cast("array<string>")), lambda t: F.lower(t).isin(*GLOSSARY_TAGS))
    sentences = F.transform(F.split("text", r"(?<=[.!?])(?![.!?])|\n"), strip)
    rows = chunks.select("filename", "chunk_seq", "page_number", tagged.alias("tagged"), sentences.alias("all"))
    rows = rows.select("filename", "chunk_seq", "page_number", "tagged", "all", F.posexplode("all").alias("item_seq", "s"))
    before = F.lower(F.regexp_replace(F.coalesce(F.get("all", F.col("item_seq") - 1), F.lit("")), r"[.!?]+$", ""))
    named = (F.regexp_extract("s", NAMED, 1) != "") & (F.lower(F.regexp_extract("s", NAMED, 1)) == before)
    chosen = F.when(F.col("s").rlike(IS_A), 1).when(F.col("s").rlike(MEANS), 2).when(F.col("tagged") & F.col("s").rlike(GLOSSARY), 3).when(named, 4)
    rows = rows.withColumn("rule", chosen).filter("rule is not null")
    part = lambda k: F.when(F.col("rule") == 1, F.regexp_extract("s", IS_A, k)).when(F.col("rule") == 2, F.regexp_extract("s", MEANS, k)).when(F.col("rule") == 3, F.regexp_extract("s", GLOSSARY, k)).otherwise(F.regexp_extract("s", NAMED, k))
    first_up = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))
    return rows.select("filename", "chunk_seq", "page_number", "item_seq", first_up(part(1)).alias("name"), first_up(part(2)).alias("definition"))


def rule_responses(chunks: DataFrame) -> DataFrame:
    """chunk_id, response: rule_concepts as the responses of a model, one JSON list a chunk."""
    items = rule_concepts(chunks).groupBy("filename", "chunk_seq").agg(F.array_sort(F.collect_list(F.struct("item_seq", F.col("name").alias("term"), "definition"))).alias("i"))
    listed = F.transform("i", lambda x: F.struct(x["term"].alias("term"), x["definition"].alias("definition")))
    out = chunks.select("filename", "chunk_seq", F.col("id").alias("chunk_id")).join(items, ["filename", "chunk_seq"], "left")
    return out.select("filename", "chunk_id", "chunk_seq", F.to_json(listed).alias("response"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Items of every response, in order; malformed ones give bad = true and no item."""
    parsed = F.from_json(F.coalesce("response", F.lit("[]")), RESPONSE)
    rows = responses.withColumn("items", parsed).withColumn("bad", F.col("items").isNull())
    return rows.select("filename", "chunk_id", "chunk_seq", "bad", F.posexplode_outer("items").alias("item_seq", "item")).select(
        "filename", "chunk_id", "chunk_seq", "bad", "item_seq", F.col("item.term").alias("term"), F.col("item.definition").alias("definition")
    )


def flatten_terms(items: DataFrame) -> DataFrame:
    """One definition a document and term: the last one, which may be null."""
    rows = items.filter("term is not null and term <> ''")
    return rows.groupBy("filename", "term").agg(F.max_by("definition", F.struct("chunk_seq", "item_seq")).alias("definition"))


def with_provenance(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Concepts with the page and document of their chunk."""
    src = chunks.select(F.col("id").alias("chunk_id"), "page_number")
    out = items.join(src, "chunk_id")
    return out.withColumn("id", stable_id("filename", "chunk_seq", "item_seq", "term"))


def progress_result(lines: DataFrame) -> DataFrame:
    """lines: line_no, value. result: the data (JSON) of the last complete event among
    "data: {...}" lines; malformed lines are skipped."""
    events = lines.withColumn("s", strip("value")).filter(F.col("s").startswith("data: "))
    body = F.expr("substring(s, 7)")
    # a well-formed event whose data is any JSON value: data stays text
    rows = events.select("line_no", F.from_json(body, "type string, data string").alias("j"), body.alias("body"))
    done = rows.filter(F.col("j.type") == "complete")
    return done.agg(F.max_by(F.get_json_object("body", "$.data"), "line_no").alias("result"))


def flatten_result(result: DataFrame) -> DataFrame:
    """result: one JSON object {chunk: {response}}, as progress_result gives. filename,
    chunk_id, chunk_seq, response: one row a chunk, in the object's order."""
    entries = F.map_entries(F.from_json("result", "map<string, struct<response: string>>"))
    rows = result.select(F.posexplode(entries).alias("chunk_seq", "e"))
    return rows.select(F.lit("result").alias("filename"), F.col("e.key").alias("chunk_id"), "chunk_seq", F.col("e.value.response").alias("response"))


def concept_counts(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("filename").agg(F.count("*").alias("n_concepts"))
