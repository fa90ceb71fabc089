"""Reference operators against plain-Python definitions."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from loomspark.functions.text import normalize
from loomspark.operators import chunking, concepts, evaluation, store, taxonomy, vectors
from pyspark.sql import functions as F


def fold(rows, soft_max, ignore_pages, keep_tail):
    """One document, element by element."""
    out, acc, size, prev = [], [], 0, None

    def flush():
        nonlocal acc, size
        text = "\n".join(t.strip() for _, t in acc if t.strip())
        if text:
            out.append((acc[0][0], text))
        acc, size = [], 0

    for page, text in rows:
        n = len(text.strip())
        if not ignore_pages and prev is not None and page != prev:
            flush()
        if size + n > soft_max:
            flush()
        acc.append((page, text))
        size += n
        prev = page
        if re.match(r"\s*(?:\d+[.)]|[A-Za-z][.)]|i{1,3}\.)", text):
            continue
        if re.search(r"[.)\]]$", text.strip()):
            flush()
    if keep_tail:
        flush()
    return out


def test_chunk_fold_equals_loop(spark, monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK", 5)  # documents span blocks
    rng = random.Random(3)
    docs = {f"d{i}": [(j // 4, rng.choice(["", "  ", "ab", "1. item.", "word " * rng.randint(1, 9), "End.", "x)"])) for j in range(rng.randint(1, 14))] for i in range(60)}
    docs["long"] = [(j // 9, rng.choice(["", "", "ab", "c", "1. item.", "word " * rng.randint(1, 9), "End." if j % 7 else ""])) for j in range(400)]
    rows = [(f, j, p, t) for f, d in docs.items() for j, (p, t) in enumerate(d)]
    df = spark.createDataFrame(rows, "filename string, el_seq long, page_number int, text string")
    for ignore_pages in (True, False):
        for keep_tail in (True, False):
            got = {}
            for r in chunking.chunk(df, 20, ignore_pages, keep_tail).orderBy("filename", "chunk_seq").collect():
                got.setdefault(r["filename"], []).append((r["page_number"], r["text"]))
            want = {f: x for f, d in docs.items() if (x := fold(d, 20, ignore_pages, keep_tail))}
            assert got == want


def test_propagated_tags(spark):
    rows = [("d", 1, ["Lexicon of Words", "Other"]), ("d", 2, ["Plain header"]), ("d", 3, ["OTHER", "New"]), ("d", 4, ["new"])]
    df = spark.createDataFrame(rows, "filename string, page_number int, tags array<string>")
    got = {r["page_number"]: r["tags"] for r in chunking.propagate_tags(df).collect()}
    assert got == {1: ["lexicon"], 2: ["Plain header"], 3: ["lexicon"], 4: ["lexicon"]}


def test_propagation_equals_page_by_page(spark):
    rng = random.Random(8)
    rows = []
    for f in range(40):
        heads = [f"Head {k}" for k in range(12)] + ["Terms of use", "List of Acronyms"]
        rows += [(f"f{f}", p, [rng.choice(heads[: rng.choice([12, 14])]) for _ in range(rng.randint(0, 3))]) for p in rng.sample(range(60), 25)]
    rows += [("chain", p, [f"h{p}", f"H{p - 1}" if p else "lexicon"]) for p in range(12)]
    want = {}
    for f in {r[0] for r in rows}:
        known = set()
        for _, p, tags in sorted(r for r in rows if r[0] == f):
            low = [t.lower() for t in tags]
            found = {k for k in chunking.KEYWORDS if any(k in t for t in low)} | ({"lexicon"} if known & set(low) else set())
            known |= set(low) if found else set()
            want[f, p] = sorted(found) if found else tags
    df = spark.createDataFrame(rows, "filename string, page_number int, tags array<string>")
    assert {(r["filename"], r["page_number"]): r["tags"] for r in chunking.propagate_tags(df).collect()} == want


def test_normalize(spark):
    rows = spark.createDataFrame([("deployment.3",), ("  A  B;",)], "x string").select(normalize("x").alias("y")).collect()
    assert [r["y"] for r in rows] == ["deployment. ", "a b"]


def test_upsert_last_wins(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old"), (None, 3, "old")], "id string, ord int, v string")
    batch = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), ("c", 1, "z"), (None, 9, "n")], "id string, ord int, v string")
    assert [(r["id"], r["v"]) for r in store.upsert(base, batch).orderBy("ord").collect()] == [("b", "old"), ("c", "z"), ("a", "y"), (None, "n")]
    dated = store.upsert(base.selectExpr("*", "timestamp'2020-01-01' as created"), batch.selectExpr("*", "cast(null as timestamp) as created"), now=F.expr("timestamp'2021-01-01'"))
    assert [(r["v"], r["created"].year) for r in dated.orderBy("ord").collect()] == [("old", 2020), ("z", 2021), ("y", 2021), ("n", 2021)]


def test_labels_first_truth_row_wins(spark):
    t = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3)], "filename string, gt_seq long")
    c = spark.createDataFrame([("f", 10), ("f", 11)], "filename string, concept_seq long")
    best = spark.createDataFrame([("f", 2, 10, 0.9), ("f", 1, 10, 0.7)], "filename string, gt_seq long, concept_seq long, score double")
    got = {(r["kind"], r["gt_seq"], r["concept_seq"]) for r in evaluation.label(t, c, best).collect()}
    assert got == {("TP", 1, 10), ("FN", 2, 10), ("FN", 3, None), ("FP", None, 11)}


def test_preorder_and_validation(spark):
    rows = [("r", None, 0), ("a", "r", 0), ("b", "r", 1), ("c", "a", 0), ("x", "y", 0), ("y", "x", 0), ("l", "gone", 0)]
    n = spark.createDataFrame(rows, "node_id string, parent_id string, child_ord int")
    order = taxonomy.preorder(n)
    assert [r["node_id"] for r in order.orderBy("path").collect()] == ["r", "a", "c", "b"]
    assert {(r["error"], r["node_id"]) for r in taxonomy.validate(n).collect()} == {("parent not found", "l"), ("in a cycle", "x"), ("in a cycle", "y")}
    more = n.unionByName(spark.createDataFrame([("p", "x", 0), ("q", "p", 0), ("m", "l", 0), ("s", "s", 0)], n.schema))
    cut = {("not reachable", "p"), ("not reachable", "q"), ("not reachable", "m")}
    assert {(r["error"], r["node_id"]) for r in taxonomy.validate(more).collect()} == {("parent not found", "l"), ("in a cycle", "x"), ("in a cycle", "y"), ("in a cycle", "s"), *cut}
    assert [r["node_id"] for r in taxonomy.preorder(more).orderBy("path").collect()] == ["r", "a", "c", "b"]


def test_decide_bounds(spark):
    rows = [("n", "d", "x", 0.5), ("n", "d", "x", 0.65), ("n", "d", "x", 0.49), ("n", "", "x", 0.9)]
    df = spark.createDataFrame(rows, "name string, definition string, node string, similarity double")
    got = taxonomy.decide(df).select("result", F.col("best_matching_node").isNull().alias("none")).collect()
    assert [tuple(r) for r in got] == [("Insert", False), ("Merge", False), ("Reject", False), ("Reject", True)]


def test_rule_concepts_examples(spark):
    rows = [
        ("Cooperation. Cooperation between organizational and national authorities is essential. Principles of cooperation are outlined in relevant policies.", ["Introduction"]),
        ("The command and control of the process will be determined during an early stage.", ["Chapter 3"]),
        ("Movement. Movement is the set of activities involved in the transfer of personnel.", ["Roles"]),
        ("deployment The relocation of forces to an area. Logistics The science of planning.", ["Lexicon"]),
        ("Alpha is the a. Beta is a b. Gamma are the c.\nDelta is an d", []),
        ("deployment The relocation of forces.", None),
        ("MOVEMENT. Movement is moving people. Movement is slow.\nSupply line\nsupply line is whatever carries supplies", None),
        ("Carrier means one who carries. A host refers to hosts! Depth is defined as distance below. It is clear. That is essential.", None),
    ]
    df = spark.createDataFrame([("f", i, 1, t, g) for i, (t, g) in enumerate(rows)], "filename string, chunk_seq long, page_number int, text string, page_tags array<string>")
    got = {}
    for r in concepts.rule_concepts(df).orderBy("chunk_seq", "item_seq").collect():
        got.setdefault(r["chunk_seq"], []).append((r["name"], r["definition"]))
    assert got == {
        2: [("Movement", "The set of activities involved in the transfer of personnel")],
        3: [("Deployment", "The relocation of forces to an area"), ("Logistics", "The science of planning")],
        4: [("Alpha", "The a"), ("Beta", "A b"), ("Gamma", "The c"), ("Delta", "An d")],
        6: [("Movement", "Moving people"), ("Supply line", "Whatever carries supplies")],
        7: [("Carrier", "One who carries"), ("A host", "Hosts"), ("Depth", "Distance below")],
    }


def test_progress_log(spark):
    lines = [(1, 'data: {"type": "complete", "data": {"a": {"response": "[]"}}}'), (2, "data: {bad"), (3, '\t data: {"type": "complete", "data": {"k": {"response": "[{\\"term\\": \\"x\\"}]"}}} \r'), (4, 'data: {"type": "progress", "data": 1}'), (5, "noise")]
    result = concepts.progress_result(spark.createDataFrame(lines, "line_no int, value string"))
    rows = concepts.parse_responses(concepts.flatten_result(result)).collect()
    assert [(r["chunk_id"], r["term"]) for r in rows] == [("k", "x")]


def test_edition_lines(spark):
    df = spark.createDataFrame([("f", 1, 1, "Text", "  Edition A", 730.0), ("f", 2, 1, "Text", "edition b", 700.0)], "filename string, el_seq long, page_number int, category string, text string, y double")
    assert [r["el_seq"] for r in chunking.drop_headers(df).collect()] == [2]


def test_scores_equal_loop(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcd. ") for _ in range(rng.randint(0, 9)))
    truth = [("f", i, rng.randint(1, 4), word(), word()) for i in range(15)] + [("f", 90, 2, None, "")]
    found = [("f", i, rng.randint(1, 4), word(), word()) for i in range(15)] + [("f", 91, 2, "", None)]
    t = spark.createDataFrame(truth, "filename string, gt_seq long, page_number int, name string, definition string")
    c = spark.createDataFrame(found, "filename string, concept_seq long, page_number int, name string, definition string")

    def norm(x):
        return re.sub(r"\.\d+\s*", ". ", re.sub(r"\s+", " ", (x or "").lower()).strip()).strip(".,;:")

    def ratio(a, b):
        return max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())

    def loop(strict):
        out = {}
        for _, i, p, n, d in truth:
            for _, j, q, m, e in found:
                if abs(p - q) <= 1:
                    n1, n2, d1, d2 = map(norm, (n, m, d, e))
                    s = ratio(d1, d2)
                    if not strict and "." in d2:
                        s = max(s, ratio(d1, d2.split(".")[0]))
                    out[i, j] = 0.6 * s + 0.25 * (1.0 if n1 in n2 or n2 in n1 else ratio(n1, n2)) + 0.15 * (p == q)
        return out

    pairs = evaluation.candidates(t, c)
    for strict in (False, True):
        want = loop(strict)
        got = {(r["gt_seq"], r["concept_seq"]): r["score"] for r in evaluation.score(pairs, strict).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
        few = {(r["gt_seq"], r["concept_seq"]): r["score"] for r in evaluation.score(pairs, strict, 0.6).collect()}
        assert {k for k, v in want.items() if v >= 0.6} <= few.keys() and len(few) < len(want)
    best = {(r["gt_seq"], r["concept_seq"]) for r in evaluation.best_matches(evaluation.score(pairs, threshold=0.6)).collect()}
    want, page = loop(False), {j: q for _, j, q, _, _ in found}
    first = {}
    for (i, j), v in sorted(want.items(), key=lambda x: (x[0][0], -x[1], page[x[0][1]], x[0][1])):
        first.setdefault(i, (v, j))
    assert best == {(i, j) for i, (v, j) in first.items() if v >= 0.6}


def test_nearest_nodes_equal_loop(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 70)
    t = np.concatenate([np.repeat(rng.integers(-1, 2, (1, 3)) / 2, 100, 0), rng.integers(-2, 3, (100, 3)) / 2]).astype(np.float32)
    x = np.concatenate([t[:1], rng.integers(-2, 3, (40, 3)) / 2]).astype(np.float32)
    ids = rng.permutation(len(t)) + 500
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, embedding array<float>")
    n = spark.createDataFrame([(int(i), v.tolist(), int(i) % 2) for i, v in zip(ids, t, strict=True)], "node_id long, embedding array<float>, kind int")
    for where, some in ((None, ids >= 0), (F.col("kind") == 1, ids % 2 == 1)):
        got = {(r["query_id"], r["rank"]): r["node_id"] for r in vectors.nearest_nodes(q, n, 3, where).collect()}
        want = {}
        for i, v in enumerate(x):
            d = ((t[some].astype(float) - v.astype(float)) ** 2).sum(1)
            for k, j in enumerate(np.lexsort((ids[some], d))[:3]):
                want[i, k + 1] = ids[some][j]
        assert got == want
    assert vectors.nearest_nodes(q.limit(0), n).count() == 0 and vectors.nearest_nodes(q, n.limit(0)).count() == 0


def test_embedding_sees_whole_words():
    a, b, c = vectors.hashed_embedding(pd.Series(["computation", "computative", "computation  Computation"]))
    assert a != b and a == c and abs(sum(v * v for v in a) - 1) < 1e-6


def test_new_parents_in_order(spark):
    n = spark.createDataFrame([("r", None, 0, "r", "d"), ("a", "r", 0, "a", "d"), ("b", "r", 1, "b", "d")], "node_id string, parent_id string, child_ord int, name string, definition string")
    new = [("x", "a", 1), ("y", "a", 2), ("z", "b", 3), ("w", "r", 4)]
    c = spark.createDataFrame([(i, k, s, i, "d", "f", 1) for i, k, s in new], "concept_id string, node_id string, concept_seq long, name string, definition string, filename string, page_number int")
    out = taxonomy.insert_parents(n, c)
    assert {(r["node_id"], r["parent_id"]) for r in out.collect()} == {("w", None), ("r", "w"), ("x", "r"), ("y", "x"), ("a", "y"), ("z", "r"), ("b", "z")}
    assert [r["node_id"] for r in taxonomy.preorder(out).orderBy("path").collect()] == ["w", "r", "x", "y", "a", "z", "b"]


def test_strict_validation(spark):
    n = spark.createDataFrame([("r", None, 0), ("s", None, 1)], "node_id string, parent_id string, child_ord int")
    with pytest.raises(ValueError, match="several roots: r"):
        taxonomy.validate(n, strict=True)
