"""The line field against all labellings, very long texts, and passages with unrepeated lines."""

import itertools
import time
from collections import Counter

import numpy as np
import pytest
from loomspark.llm import line_crf, line_dedup


def by_all_labellings(u, trans):
    """P(good) of every line and the log partition of one text."""
    total, good = [], [[] for _ in u]
    for ys in itertools.product((0, 1), repeat=len(u)):
        s = sum(u[t] * y for t, y in enumerate(ys)) + sum(trans[a][b] for a, b in zip(ys, ys[1:]))
        total.append(s)
        for t, y in enumerate(ys):
            if y:
                good[t].append(s)
    z = np.logaddexp.reduce(total)
    return [float(np.exp(np.logaddexp.reduce(g) - z)) for g in good], z


@pytest.mark.parametrize("stretch", [1, 2, 3, 256])
def test_marginals_equal_all_labellings(monkeypatch, stretch):
    monkeypatch.setattr(line_crf, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    sizes = [1, 7, 2, 9, 5, 1, 8]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    x, w, trans = rng.normal(size=(len(owner), line_crf.FEATURES)), rng.normal(size=line_crf.FEATURES), rng.normal(size=(2, 2))
    good, pair, z = line_crf.LineCrf(w, trans).marginals(x, owner)
    for k in range(len(sizes)):
        want, z_want = by_all_labellings(x[owner == k] @ w, trans)
        assert np.allclose(good[owner == k], want) and np.isclose(z[k], z_want)
    # expected transitions are the gradient of the log partitions
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        up, down = (line_crf.LineCrf(w, trans + d).marginals(x, owner)[2].sum() for d in (step, -step))
        assert np.isclose(pair[a, b], (up - down) / 2e-5, rtol=1e-4)


def test_very_many_lines(spark):
    rows = [(i, ("A good line of plain words.\n" if i % 2 else "$$ BUY @@ 99 $$ !!!\n") * (1 + i % 5)) for i in range(60)]
    rows += [(100, "A good line of plain words.\n" * 150_000), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (101, 0), (None, 1), (999, 1)], "doc_id long, quality int")
    began = time.time()
    got = {r["doc_id"]: r for r in line_crf.classify(docs, learn).collect()}
    assert time.time() - began < 60
    assert len(got) == len(rows) and got[100]["score"] > 0.9 and got[100]["n_lines"] == 150_001
    assert all((got[i]["score"] > 0.5) == bool(i % 2) for i in range(60))
    assert line_crf.classify(docs.limit(0), learn).count() == 0
    assert {r["score"] for r in line_crf.classify(docs.limit(3), learn.limit(0)).collect()} == {0.5}


def test_unrepeated_short_units_stay(spark):
    said = "This sentence is said again and again in all of these documents and is long enough for a passage by itself. "
    rows = [(1, said + "Yes.\n" + said), (2, said + "Total 977.\n" + said), (3, said + "Yes.\n" + said), (4, "Yes.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["text"] for r in line_dedup.dedup_units(docs, min_passage=100).collect()}
    assert got[2].strip() == "Total 977." and got[3].strip() == "" and got[4] == "Yes."
    # every later occurrence of a line, whatever its size
    rows = [(i, "a\nlong line of words\nb" + f"\n{i}") for i in range(3)] + [(9, "x" * 1_200_000 + "\na")]
    lines = line_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), "line", 1, 1).collect()
    assert Counter({r["row"]["doc_id"]: r["n_removed"] for r in lines}) == Counter({0: 0, 1: 3, 2: 3, 9: 1})
