"""Corpus operators against brute force on a small fixture with nulls, ties and repeats."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from loomspark.llm import components, decontaminate, language_id, license_scan, line_crf, line_dedup, masked_lm, mixing, ngram_quality, simhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, rows long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(1, 8))) for _ in range(300)] + ["Ünter", "İx", "K"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = text(60)
    out = [(i, text(rng.randint(1, 90)) + ("\n" + shared if i % 5 == 0 else "") + "\n" + text(20), ["en", "de", None][i % 3], ["b", "a", None, ""][i % 4]) for i in range(60)]
    out += [(100, None, None, None), (101, "", "en", "a"), (None, text(30), "en", "b"), (102, "\n\n", "de", "b"), (103, "x " * 3000, "en", "a")]
    out += [(104, out[0][1], "en", "a"), out[3], out[3]]
    return [(*r, 0, 1, 2) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def counted(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_suffix_dedup(docs, rows):
    length = 40
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    want = Counter()
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = counted(suffix_dedup.removal_digest(docs, length, 12), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want
    assert suffix_dedup.removal_digest(docs.limit(0)).count() == 0


def test_simhash(docs, rows):
    def fp(text):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fp(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 2 and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {c: min((r[0] for r, d in zip(rows, comp, strict=True) if d == c and r[0] is not None), default=None) for c in comp}
    want = Counter((r[0], f"{x:016x}", least[c]) for r, x, c in zip(rows, f, comp, strict=True))
    out = simhash_dedup.near_duplicates(docs).withColumn("fingerprint", simhash_dedup.hex_fingerprint())
    assert counted(out, "doc_id", "fingerprint", "component_id") == want
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_links_are_exact(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(63) for _ in range(40)]
    fps += [x ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for x in fps] + [x ^ 7 for x in fps[:20]]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(0, x) for x in fps], "t int, fp long")
    plan = simhash_dedup.plan(df.select("fp"))
    assert sum(t for _, t in plan) == 2 - len(plan) + 1 and sorted(b for g, _ in plan for b in g) == list(range(64))
    edges = simhash_dedup.links(simhash_dedup.candidates(df, plan)).select("a", "b")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    root = {x: x for x in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert all(got.get(x, x) == root[x] for x in fps)


def test_drop_near_duplicates_keeps_one(spark):
    words = [f"w{i}" for i in range(400)]
    near = words.copy()
    near[50], near[300] = "other", "changed"
    rows = [(1, " ".join(words), None, None, 0, 0, 0), (2, " ".join(near), None, None, 0, 0, 0), (3, " ".join(reversed(words[:200])) + " alone", None, None, 0, 0, 0)]
    rows += [rows[0], rows[0]]
    out = simhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert counted(out, "doc_id") == Counter({(1,): 1, (3,): 1})


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(size.values()), {}, list(names)
    while True:
        left = total - sum(target.values())
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * size[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        free = [s for s in free if s not in over]
    taken = Counter()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_ngram_base_counts(docs, rows):
    def base(text):
        t = text or ""
        w = WORD.findall(t)
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)

    want = Counter()
    for r in rows:
        b = base(r[1])
        want[(r[0], *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    out = ngram_quality.quality_rules(docs)
    assert counted(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not [r for r in out.collect() if r["kept"] and r["base_failed"]]
    assert ngram_quality.quality_rules(docs.limit(0)).count() == 0


def test_ngram_model_sums_to_one(docs):
    import numpy as np

    t = ngram_quality.count_ngrams(docs).toArrow()
    m = ngram_quality.fit_model(t["code"].to_numpy(), t["n"].to_numpy())
    v = ngram_quality.CLASSES
    seen = np.unique(m.codes // v)  # contexts
    some = np.concatenate([seen, np.arange(0, v**3, 97)])
    p = (2.0 ** m.log_prob((some[:, None] * v + np.arange(v)).reshape(-1)).astype(np.float64)).reshape(-1, v).sum(1)
    assert np.allclose(p, 1, atol=1e-3)


def test_ngram_tokens_are_characters():
    import pyarrow as pa
    from loomspark.llm.common import chunks

    texts = ["abé€😀", "", "éa"]
    (chunk,) = chunks(pa.array(texts))
    codes, at = ngram_quality.codes_of(chunk)
    v = ngram_quality.CLASSES
    assert at.tolist() == [0, 5, 5, 7] and (codes % v)[0] == 1 and (codes % v)[2] == (codes % v)[5] and codes[5] < v and all((codes % v)[2:5] >= ngram_quality.ASCII)
    assert codes[1] == v + 2 and codes[6] == (codes[5] % v) * v + 1


def test_decontamination(spark):
    rng = random.Random(2)
    w = lambda n: [f"q{rng.randrange(5000)}" for _ in range(n)]
    items = [w(20), w(33), w(33), ["few", "words"]]
    near = items[1].copy()
    near[0] = "edge"
    docs = [w(40) + items[0] + w(5), w(9) + near, w(50), items[3], w(3) + items[2][:16]]
    d = spark.createDataFrame([(i, " ".join(x), None, None, 0, 0, 0) for i, x in enumerate(docs)] + [(9, None, None, None, 0, 0, 0), (10, "", None, None, 0, 0, 0)], SCHEMA)
    b = spark.createDataFrame([(i, ", ".join(x).upper()) for i, x in enumerate(items)] + [(7, None), (8, "")], "item_id long, text string")
    got = counted(decontaminate.contaminated(d, b), "doc_id", "item_id", "first_word")
    assert got == Counter({(0, 0, 40): 1, (1, 1, 9): 1, (3, 3, 0): 1})
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_license_scan(spark):
    text = "Foo UNDER the\nMIT  License, cc-by NC!\nThis work is licensed under the GNU General Public License, version 3."
    d = spark.createDataFrame([(1, text, None, None, 0, 0, 0), (2, None, None, None, 0, 0, 0), (3, "plain é text", None, None, 0, 0, 0)], SCHEMA)
    got = {r["doc_id"]: r for r in license_scan.license_scan(d).collect()}
    r = got[1]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (20, 2, 1, 5, "cc-by-nc,mit", "cc-by-nc,gpl-3,mit", 1.0)
    assert (got[2]["n_words"], got[2]["labels"], got[3]["n_words"], got[3]["score"]) == (0, "", 3, 0.0)


def removed_passages(rows, min_unit, min_passage):
    """(doc_id, text, n_removed, spans) of dedup_units(unit="sentence"), unit by unit."""
    cut = re.compile("[^.!?\n]+[.!?]*|[.!?]+|\n")
    tokens = [[(m.start(), m.end()) for m in cut.finditer(t or "")] for _, t in rows]
    seen, out = set(), [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        doc_id, text = rows[i]
        units = [(k, n) for k, (a, b) in enumerate(tokens[i]) if len(n := " ".join(text[a:b].lower().split())) >= min_unit]
        runs, run = [], []
        for k, norm in units:
            if norm in seen:
                run.append((k, norm))
            elif run:
                runs, run = [*runs, run], []
            seen.add(norm)
        spans, n = [], 0
        for r in [*runs, run]:
            if r and sum(len(x) for _, x in r) >= min_passage:
                spans.append((tokens[i][r[0][0]][0], tokens[i][r[-1][0]][1]))
                n += len(r)
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        out[i] = (doc_id, None if text is None else kept + text[at:], n, tuple(spans))
    return Counter(out)


def test_line_dedup(spark):
    rng = random.Random(8)
    units = ["".join(rng.choice("abc de") for _ in range(rng.randint(1, 12))).strip() + rng.choice([".", "!", "?!", "\n", ". "]) for _ in range(40)]
    rows = [(i, "".join(rng.choice(units) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, rows[3][1]), (202, rows[3][1]), (203, "\n\n.."), rows[5], rows[5], rows[5]]
    d = spark.createDataFrame([(i, t, "r", "k") for i, t in rows], "doc_id long, text string, runs string, g_id string")
    out = line_dedup.dedup_units(d, "sentence", 4, 12)
    got = Counter((r["row"]["doc_id"], r["text"], r["n_removed"], tuple(tuple(x) for x in r["removed"] or [])) for r in out.collect())
    assert got == removed_passages(rows, 4, 12) and sum(n for _, _, n, _ in got) > 50
    assert out.filter("row.runs = 'r' and row.g_id = 'k'").count() == len(rows)
    assert line_dedup.dedup_units(d.limit(0)).count() == 0


def test_line_dedup_units(spark):
    rows = [(1, "Head\none two three\n\nmore of it\nend"), (2, "ONE  two three\nother\n\nMore of it\nEND\n\n\nnew")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda unit: {r["row"]["doc_id"]: r["text"] for r in line_dedup.dedup_units(d, unit, 3, 3).collect()}
    assert texts("line") == {1: rows[0][1], 2: "\nother\n\n\n\n\nnew"}
    assert texts("paragraph") == {1: rows[0][1], 2: "ONE  two three\nother\n\n\n\n\nnew"}


def test_models(spark, docs, rows):
    for n in (docs.count(),):
        assert masked_lm.pseudo_likelihood(docs, 1).filter("log_likelihood <= 0").count() == n
    rng = random.Random(1)
    sides = [(" ".join(rng.choice(v) for _ in range(60)), lang) for v, lang in ((["the", "and", "of", "house"], "en"), (["der", "und", "von", "haus"], "de")) for _ in range(200)]
    d = spark.createDataFrame([(i, t, g, None, 0, 0, 0) for i, (t, g) in enumerate(sides)] + [(900, None, None, None, 0, 0, 0), (901, "12 !", "en", None, 0, 0, 0)], SCHEMA)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d, d.filter("doc_id % 2 = 0")).collect()}
    assert all(got[i] == g for i, (_, g) in enumerate(sides)) and got[900] == got[901] == "und"
    text = [("Good plain words here.\n" * 4, 1), ("BAD!! ### BAD!! $$$\n" * 4, 0)] * 60
    d = spark.createDataFrame([(i, t, None, None, 0, 0, 0) for i, (t, _) in enumerate(text)] + [(900, None, None, None, 0, 0, 0)], SCHEMA)
    lab = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(text) if i < 80], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in line_crf.classify(d, lab).collect()}
    assert all((got[i] >= 0.3) == (q == 1) for i, (_, q) in enumerate(text)) and 0 <= got[900] <= 1


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(11)
    w = lambda n: [f"q{rng.randrange(50000)}" for _ in range(n)]
    items = [w(49 + i % 11) for i in range(60)]
    docs = []
    for item in items:  # one inner word replaced: similarity 0.8 to 0.83
        edited = item.copy()
        edited[len(item) // 2] = "edited"
        docs.append(w(30) + edited + w(30))
    d = spark.createDataFrame([(i, " ".join(x), None, None, 0, 0, 0) for i, x in enumerate(docs)], SCHEMA)
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(100, " ".join(items[0]))], "item_id long, text string")
    got = counted(decontaminate.contaminated(d, b), "doc_id", "item_id", "first_word")
    assert got == Counter({(i, i, 30): 1 for i in range(60)} | {(0, 100, 30): 1})


def test_decontamination_clipped_windows_and_short_items(spark):
    rng = random.Random(12)
    w = lambda n: [f"q{rng.randrange(50000)}" for _ in range(n)]
    a, b = w(30), w(60)
    items = [a, b, ["only", "three", "words"], ["solo"]]
    docs = [a[:28], a[2:], w(40) + b[:50], b[10:] + w(40), w(40) + b[:45], w(9) + items[2] + w(9) + items[2], ["solo"], w(7) + ["solo"]]
    d = spark.createDataFrame([(i, " ".join(x), None, None, 0, 0, 0) for i, x in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = counted(decontaminate.contaminated(d, bench), "doc_id", "item_id", "first_word", "n_words")
    assert got == Counter([(0, 0, 0, 28), (1, 0, 0, 28), (2, 1, 40, 50), (3, 1, 0, 50), (5, 2, 9, 3), (6, 3, 0, 1), (7, 3, 7, 1)])


def test_license_scan_wrapped_notices(spark):
    import textwrap

    notices = dict(license_scan.TEMPLATES[i] for i in (0, 4, 6))  # mit, gpl-3, bsd
    filler = "\n".join(f"line {i} of other text" for i in range(20))
    wrapped = {k: "\n".join(f" * {x}" for x in textwrap.wrap(t, 72)) for k, t in notices.items()}
    rows = [(i, f"{filler}\n/*\n{x}\n\n */\n{filler}", None, None, 0, 0, 0) for i, x in enumerate(wrapped.values())]
    half = wrapped["gpl-3"].split("\n")
    rows += [(7, filler, None, None, 0, 0, 0), (8, half[0] + "\n" + filler + "\n" + "\n".join(half[1:]), None, None, 0, 0, 0)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**dict(enumerate(wrapped)), 7: "", 8: ""}


def test_no_language_is_lost(spark):
    long = "\n".join(f"wort zwei drei {i}" for i in range(30_000))
    rows = [(i, "some short lines\nof two words\n" * 40, "en") for i in range(300)] + [(1000, long, "xx"), (1001, "kurz", "yy"), (1002, "", "zz"), (1003, None, "zz")]
    for k in range(3):  # other ids, other draws
        d = spark.createDataFrame([(i + 7919 * k, t, g) for i, t, g in rows], "doc_id long, text string, lang string")
        got = counted(language_id.training_rows(d, 200).groupBy("lang").count(), "lang", "count")
        assert got == Counter([("en", 200), ("xx", 200), ("yy", 1)])
    assert language_id.identify(d.limit(0), d.limit(0)).count() == 0


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, h long, rows long, spans string, s_own long, maybe string, bm_own long, todo string, t_key long, b_id long, b_lang string, g_id long, g_h long, row string, place long, root string, fp string, salt string"


def test_stages_keep_clashing_columns(spark, rows):
    wide = [(*r, *["x" if " string" in c else 7 for c in CLASHES.split(", ")[7:]]) for r in rows]
    d = spark.createDataFrame(wide, CLASHES)
    bench = spark.createDataFrame([(1, " ".join(rows[0][1].split()[:12])), (2, None)], "item_id long, text string")
    stages = {
        "rejected": ngram_quality.drop_rejected,
        "near": simhash_dedup.drop_near_duplicates,
        "repeats": lambda x: suffix_dedup.remove_repeats(x, 40, 12),
        "leaks": lambda x: decontaminate.drop_contaminated(x, bench),
    }
    for name, stage in stages.items():
        out = stage(d)
        assert out.columns == d.columns, name
        got = out.collect()
        assert got and all(r["spans"] == "x" and r["b_id"] == 7 and r["h"] == 1 for r in got), name
        empty = stage(d.limit(0))
        assert empty.columns == d.columns and empty.count() == 0, name
        if name == "repeats":
            assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        if name == "leaks":
            assert not {0, 104} & {r["doc_id"] for r in got} and len(got) == len(rows) - 2


@pytest.mark.parametrize("small", [simhash_dedup.SMALL, 1])
def test_similar_texts_equal_brute_force(spark, monkeypatch, small):
    """With small = 1 every shared member goes through the rounds of pivots, which must lose no link."""
    monkeypatch.setattr(simhash_dedup, "SMALL", small)
    rng = random.Random(21)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randint(40, 160))] for _ in range(12)]
    texts = []
    for k, words in enumerate(base):
        texts.append(" ".join(words))
        for _ in range(30 if k == 0 else 3):  # one large group of near copies
            copy = words.copy()
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(copy))
    passage = base[3][:40] + base[4][:40]
    for _ in range(12):  # unlike texts around one passage, each with a near copy of its own
        own = [f"y{rng.randrange(900)}" for _ in range(60)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1] + ["z"])]
    texts += ["", None, "a b", "A  b", texts[0], " ".join(base[1] + base[2])]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sets[i] | sets[j]
            if root[i] != root[j] and (not both or len(sets[i] & sets[j]) / len(both) >= 0.8):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in simhash_dedup.similar_texts(d).collect()}
    classes = lambda names: {frozenset(i for i in range(len(texts)) if names[i] == names[k]) for k in range(len(texts))}
    assert classes(got) == classes(root) and len(set(root)) < len(texts) - 20
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(d).collect()}
    assert kept == {min(c) for c in classes(root)}
