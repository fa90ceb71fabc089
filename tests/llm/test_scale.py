"""What must stay small, and what must be whole, whatever the input."""

import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from loomspark.llm import common, components, decontaminate, masked_lm, mixing, ngram_quality, simhash_dedup, suffix_dedup
from loomspark.llm.common import chunks
from pyspark.sql import functions as F


def test_mixing_joins_without_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * i, "s") for i in range(9)], "doc_id long, text string, source string")
    labels = mixing.label_weights(spark.createDataFrame([(3, 0)], "doc_id long, quality int"))
    plans, write = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan()) or write(df, tag))
    assert mixing.mix_sources(docs, labels).count() == 9
    joins = [line for line in plans[0].toString().split("\n") if "Join" in line]
    assert joins and "text" not in {a.name() for a in _outputs(plans[0], "Join")}


def _outputs(plan, kind):
    """Columns of every node of that kind."""
    found, nodes = [], [plan]
    while nodes:
        p = nodes.pop()
        if p.nodeName() == kind:
            found += [p.output().apply(i) for i in range(p.output().size())]
        nodes += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_every_token_is_trained_once():
    texts = ["", "a b", None, "long " * 20_001, *[f"word{i} of {i % 7}" for i in range(3000)]]
    total, net = 0, masked_lm.WindowNet.start()
    for k in range(masked_lm.ROUNDS):
        out = masked_lm._trainer(SimpleNamespace(value=net), k, masked_lm.ROUNDS)([pa.record_batch([pa.array(texts)], ["text"])])
        total += sum(r["weight"] for b in out for r in b.to_pylist() if r["part"] == "position" and r["row"] == 0)
    assert total == 2 + 20_001 + 9000


def test_log_prob_equals_the_formula(monkeypatch):
    monkeypatch.setattr(masked_lm, "STEP", 5)
    net, w = masked_lm.WindowNet.start(), masked_lm.WINDOW
    (chunk,) = chunks(pa.array(["a b c d e f g h", "", "b a b"]))
    stream, at, _ = masked_lm.tokens(chunk)
    got = np.concatenate([net.log_prob(p) for p in masked_lm.pieces(stream)])[at - w]
    assert len(got) == 11
    for place, have in zip(at, got, strict=True):
        h = np.tanh(sum(net.embed[stream[place + o]] * net.position[k] for k, o in enumerate(masked_lm.OFFSETS)))
        g, j = divmod(stream[place], masked_lm.WITHIN)
        want = 0.0
        for layer, i in ((net.group, g), (net.within[g * masked_lm.WITHIN :][: masked_lm.WITHIN], j)):
            z = layer[:, :-1] @ h + layer[:, -1]
            want += z[i] - np.log(np.exp(z).sum())
        assert np.isclose(have, want, atol=1e-4)


def test_ngram_counts_take_the_memory_of_what_is_seen():
    texts = ["", None, *[f"word{i} of {i % 7}\n" * 5 for i in range(3000)]]
    want = Counter()
    for chunk in chunks(pa.array(texts)):
        want.update(ngram_quality.codes_of(chunk)[0].tolist())
    batches = [pa.record_batch([pa.array(texts[lo : lo + 100])], ["text"]) for lo in range(0, len(texts), 100)]
    list(ngram_quality._count(batches))
    tracemalloc.start()
    out = list(ngram_quality._count(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = Counter()
    for b in out:
        got.update(dict(zip(b["code"].to_pylist(), b["n"].to_pylist(), strict=True)))
    assert got == want and sum(b.num_rows for b in out) == len(want)
    assert peak < 60 << 20
    assert not sum(b.num_rows for b in ngram_quality._count([]))


def _joins(plan):
    """All joins of an optimized plan, with their hints."""
    return [line for line in plan.toString().split("\n") if "Join " in line and "Join Cross" not in line]


def test_probes_are_not_broadcast(spark):
    """34 probes a fingerprint lie behind a small file."""
    fps = spark.range(3).select(F.lit(0).alias("t"), F.col("id").alias("fp"))
    found = simhash_dedup.candidates(fps, [(list(range(32)), 1), (list(range(32, 64)), 0)])
    joins = _joins(found._jdf.queryExecution().optimizedPlan())
    assert joins and all("strategy=" in line for line in joins)


def test_no_join_is_left_to_the_size_of_files(spark, monkeypatch):
    """An explode or an aggregate behind a small file may hold more than the driver: every join of
    the pipeline's dedup stages says how it is done."""
    rng = np.random.default_rng(3)
    words = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"], 60)) for _ in range(3)]
    texts = [t + f" {k}" for t in words for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = docs.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id % 40 = 0")
    plans = []
    for module in (common, components, simhash_dedup, suffix_dedup, decontaminate):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, tag, write=write: plans.append(df._jdf.queryExecution().optimizedPlan()) or write(df, tag))
    for out in (simhash_dedup.near_duplicates(docs), simhash_dedup.drop_near_duplicates(docs), suffix_dedup.remove_repeats(docs), decontaminate.drop_contaminated(docs, bench)):
        plans.append(out._jdf.queryExecution().optimizedPlan())
    joins = [line for plan in plans for line in _joins(plan)]
    assert len(joins) > 40
    assert not [line for line in joins if "strategy=" not in line]
