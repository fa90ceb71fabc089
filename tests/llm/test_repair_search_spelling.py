"""Conversation repair, exact search and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from loomspark.llm import bit_sliced, spelling
from loomspark.llm import conversation_repair as repair

LETTERS = re.compile(r"[A-Za-zÀ-ÿ]+")
SOUND = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(turns):
    """Cost and ASCII-least audit of (initial, fault) turns by trying every edit."""

    @cache
    def best(i, state, run):
        if i == len(turns):
            ways = [(0, "")] if state in (0, 3) else []
        else:
            initial, fault = turns[i]
            ways = [(4, "D", best(i + 1, state, 0))]
            if fault < 2:
                nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))
                if nxt is not None:
                    ways.append((3 * fault, "K", best(i + 1, nxt, 0)))
                ways.append((3 + 3 * fault, "R", best(i + 1, 3 if state == 2 else 2, 0)))
            ways = [(c + w[0], e + w[1]) for c, e, w in ways]
        if run < 3:
            c, e = best(i, 3 if state == 2 else 2, run + 1)
            ways.append((3 + c, "I" + e))
        return min(ways, default=(10**9, ""))

    return best(0, 0, 0)


def turns_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        sound = SOUND.findall(text)
        out.append((role[:1], 2 if not sound else 3 if (role, text) in seen else int(sound[-1] not in ".!?")))
        seen.add((role, text))
    return out


def report(rows):
    """The contract's columns of one conversation, (turn, role, text) in order."""
    turns = turns_of(rows)
    cost, audit = cheapest(tuple(turns))
    state, i, out = 0, 0, []
    for e in audit:
        made = ("assistant", 3) if state == 2 else ("user", 2)
        if e == "I":
            out.append(made[0] + ":")
            state = made[1]
            continue
        if e == "K":
            state = {"s": 1, "u": 2, "a": 3}[rows[i][1][0]]
            out.append(f"{rows[i][1]}:{rows[i][2]}")
        elif e == "R":
            state = made[1]
            out.append(f"{made[0]}:{rows[i][2]}")
        i += 1
    numbers = {r[0] for r in rows if r[0] is not None}
    faults = Counter(t[1] for t in turns)
    pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return gaps, faults[2], faults[3], faults[1], pairs, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_conversation(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn, role if role is not None else " ", text if text is not None else " "))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {c: sorted(rs, key=key) for c, rs in out.items()}


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No! ", "cut off", "", " \n", None, "Why?", "Größe ?", " "]
    rows = []
    for c in [*range(40), None]:
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(roles[: rng.choice([2, 3, 6])]), rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}.") for t in range(rng.randint(1, 9))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"line {t % 50}.") for t in range(300)]
    return [*rows, rows[0], rows[0], (78, 5, "user", "x" * 2_000_000 + "?")]


@pytest.mark.parametrize("bits", [10, 2])
def test_repair_equals_brute_force(spark, monkeypatch, conversations, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    df = spark.createDataFrame([(*r, 1, "x") for r in conversations], "conv_id long, turn long, role string, text string, key int, block string")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(df, df).collect()}
    want = by_conversation(conversations)
    assert got.keys() == want.keys()
    for c, rows in want.items():
        if len(rows) < 30:
            assert got[c] == report(rows), c
    # of the long one, the cost by a plain backward program and the audit's own cost
    codes = "".join(repair.CODES[4 * f + "suax".index(i)] for i, f in turns_of(want[77]))
    costs, total = repair._back(codes, repair.END)
    assert got[77][5] == total + costs[0] and len(got[77][6].replace("I", "")) == 300


def test_walks_take_the_ascii_least_cheapest_edits():
    rng = random.Random(5)
    for _ in range(400):
        codes = "".join(rng.choice(repair.CODES if rng.random() < 0.5 else "suaUA") for _ in range(rng.randint(1, 12)))
        size = rng.choice([1, 2, 3, 5, 20])
        blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
        ends, cost = repair.block_ends([repair.matrix(b) for b in blocks])
        ways = [repair.walks(b, e) for b, e in zip(blocks, ends, strict=True)]
        plan = "".join(repair.composed([w[0] for w in ways], [w[1] for w in ways]))
        turns = tuple((repair._INITIAL[c], repair._FAULT[c]) for c in codes)
        assert (cost, plan.translate(str.maketrans("kuadUA", "KRRDII"))) == cheapest(turns)


def test_damage_and_empty_conversations(spark, conversations):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(conversations, schema)
    want = []
    for c, t, role, text in conversations:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = ("user" if kind == 4 else " " if role is None else role), " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert Counter(map(tuple, repair.damaged(df).collect())) == Counter(want)
    none = repair.repair_report(df.limit(0), df.select("conv_id")).collect()
    assert len(none) == 43 and {tuple(r[c] for c in COLUMNS) for r in none} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair_report(df.limit(0), df.limit(0)).count() == 0
    turns = repair.repaired_turns(df.filter("conv_id = 77")).orderBy("place").collect()
    assert [r["role"] for r in turns] == ["user", "assistant"] * (len(turns) // 2) and turns[0]["edit"] == "K"


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 100)
    monkeypatch.setattr(bit_sliced, "QUERY_BYTES", 2000)
    rng = random.Random(7)
    vector = lambda n=16: [rng.gauss(0, 0.3) for _ in range(n)]
    rows = [(i, vector()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(50, vector()), rows[100], rows[150]]  # ties, one id twice, rows twice
    rows += [(2000, None), (2050, []), (2100, [1.0, None]), (2150, [float("nan")] * 16), (2200, [float("inf")] * 16), (None, vector())]
    rows += [(2250, vector(3)), (2251, vector(3)), (2300, [0.0] * 16), (2350, [3e8] * 16), (2351, [-2e9] + [0.5] * 15), (2400, [1e300] * 16)]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    sound = [(i, [max(-(1 << 63), min((1 << 63) - 1, int(256 * x // 1))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v)]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = Counter()
    for q, v in {(i, tuple(v)) for i, v in sound if i % 50 == 0}:
        scores = sorted(((-clip(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in sound if i != q and len(w) == len(v)))[:5]
        want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scores))
    got = Counter(tuple(r) for r in bit_sliced.top_k(df, df.filter("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want
    assert bit_sliced.top_k(df.limit(0), df.limit(0)).count() == 0 and bit_sliced.top_k(df, df.limit(0)).count() == 0


def test_few_rows_are_scored_exactly():
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(5000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    s = bit_sliced._Searcher(bit_sliced._block(np.arange(5000), v), 5)
    boundary = s._boundary(v[:8], [np.array([i]) for i in range(8)])
    assert max(map(len, boundary)) < 500


def variants_by_brute_force(rows, every, least):
    n = Counter()
    for i, text in rows:
        for run in LETTERS.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % every == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in close.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return Counter((w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n)


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PROBES", 50)
    rng = random.Random(11)
    words = ["".join(rng.choice("aabéÿo") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words += [w[:k] + rng.choice("abÀ") + w[k + rng.randint(0, 1) :] for w in words for k in (2, 5)]
    words += ["aaaaaaaa", "aaaaaaa", "AAAAAAA", "Ünter×Str÷", "z" * 70, "z" * 71, "z" * 30_000, "z" * 29_999, "d̀tente"]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 50, 500])]) for _ in range(60)) + "1") for i in range(150)]
    rows += [(None, rows[0][1]), (3, None), (4, ""), (5, "123 ,"), rows[1], rows[1], (900, "longest " * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, word int, n int")
    for every, least in ((7, 2), (199, 5)):
        out = spelling.variants(spelling.vocabulary(spelling.damaged_runs(df, every), min_count=least))
        got = Counter(tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect())
        assert got == variants_by_brute_force(rows, every, least)
    assert spelling.variants(spelling.vocabulary(spelling.damaged_runs(df.limit(0)))).count() == 0


def test_crowded_filters_lose_nothing(spark, monkeypatch):
    """Filters at their size bound let more through; the exact join removes it."""
    monkeypatch.setattr(spelling, "MOST_BLOCKS", 1)
    monkeypatch.setattr(spelling, "LEAST_BLOCKS", 1)
    rng = random.Random(13)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(6, 7))) for _ in range(300)})
    df = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    got = {(r["word"], r["near"]) for r in spelling.near_words(df).collect()}
    cut = {w: {(i, w[:i] + w[i + 1 :]) for i in range(len(w))} for w in words}
    want = {(a, b) for a in words for b in words if a != b and ((len(a) == len(b) and cut[a] & cut[b]) or a in {x for _, x in cut[b]} or b in {x for _, x in cut[a]})}
    assert got == want
