"""Hard negatives, mixtures and repaired conversations against plain versions, and their edge cases."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives, mixing, registry, repair

# --- conversations


def cheapest(rows):
    """Least cost, then least audit, over all edits: Dijkstra over (row, state), with the repaired lines."""
    heap, done = [(0, "", 0, "", ())], set()
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        nxt = follows[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt, (*lines, f"{name[nxt]}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = 1 if fault == "truncated" else 0
        if role[:1] == nxt or (role[:1] == "s" and state == ""):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, nxt, (*lines, f"{name[nxt]}:{text}")))
    raise AssertionError


def plain_repair(rows):
    """One conversation's result from its (turn, role, text) in order."""
    seen, judged = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    faults = Counter(f for *_, f in judged)
    cost, audit, lines = cheapest(judged)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_op13(spark, small):
    want, lost = defaultdict(list), 0
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        h = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        row = (r.turn, "user" if h == 4 else r.role, "" if h == 1 else re.sub("[.!?]", "", r.text) if h == 2 else r.text)
        want[r.conv_id] += [] if h == 0 else [row, row] if h == 3 else [row]
        lost += h == 0
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in registry.QUERIES["op13_conversation_repair"](spark, small).collect()}
    assert lost and got == {c: plain_repair(ordered(rows)) for c, rows in want.items()}


def test_repair_edges(spark, monkeypatch):
    said = [("user", "Hi."), ("assistant", "Yes."), ("system", "Be."), ("user", "cut"), ("assistant", " \t"), ("u", "U."), ("tool", "T!"), ("", "x?"), ("user", "Hi.")]
    rng = np.random.default_rng(3)
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 9))):
            role, text = said[int(rng.integers(len(said)))]
            rows.append((conv, None if rng.random() < 0.1 else turn + int(rng.integers(0, 2)), role, text, 0, "x"))
    rows += [(None, 0, "user", "Q?", 0, "x"), (None, 1, "assistant", "A.", 0, "x"), (77, 0, None, None, 0, "x"), (78, 0, "user", "Gone.", 1, "x")]
    rows += [(79, 5, "user", "Same.", 0, "x")] * 3
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, gone int, mark string").repartition(5)
    want = defaultdict(list)
    for c, t, role, text, gone, _ in rows:
        want[c] += [] if gone else [(t, " " if role is None else role, " " if text is None else text)]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(df, F.col("gone") == 0).collect()}
    assert got == {c: plain_repair(ordered(r)) for c, r in want.items()}
    assert got[78] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert not repair.repair(df.limit(0)).collect()


def test_repair_of_giant_conversations(spark):
    """Chunks of backpointers follow one another; a third of all rows alike; a very long text."""
    n = 3 * repair.CHUNK + 100
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    same = spark.range(n).select(F.lit(2).alias("conv_id"), F.lit(7).alias("turn"), F.lit("user").alias("role"), F.lit("Again.").alias("text"))
    long = spark.createDataFrame([(3, 0, "user", "a" * 3_000_000 + "."), (3, 1, "assistant", "b.")], "conv_id int, turn bigint, role string, text string")
    got = {r.conv_id: r for r in repair.repair(turns.unionByName(same).unionByName(long)).collect()}
    assert got[1].cost == 0 and got[1].audit == "K" * n
    want = hashlib.sha256("\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:{i}." for i in range(n)).encode()).hexdigest()
    assert got[1].repaired_sha256 == want
    assert (got[2].duplicate, got[2].gaps, got[2].cost, got[2].audit) == (n - 1, 0, 3 * (n - 1) + 2, "K" + "D" * (n - 1) + "I")
    assert got[3].cost == 0


# --- mixtures


def test_op12(spark, small):
    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    sources = defaultdict(int)
    for d in docs:
        sources[d["source"]] += size[d["doc_id"]]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sources, key=lambda s: (s is None, (s or "").encode())))}
    # The rule as stated: share, stop those above, share again
    total, stopped = sum(sources.values()), set()
    while True:
        free = [s for s in sources if s not in stopped]
        left = total - sum(3 * sources[s] for s in stopped)
        target = {s: 3.0 * sources[s] if s in stopped else left * weight[s] / sum(weight[f] for f in free) for s in sources}
        over = {s for s in free if target[s] > 3 * sources[s]}
        if not over:
            break
        stopped |= over
    got = [r.asDict() for r in registry.QUERIES["op12_entropy_mixture"](spark, small).collect()]
    again = [r.asDict() for r in registry.QUERIES["op12_entropy_mixture"](spark, small).collect()]
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)
    of, taken = {d["doc_id"]: d["source"] for d in docs}, defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        s = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sources[s])
        assert r["target"] == pytest.approx(target[s], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    smallest = {s: min(size[d] for d in size if of[d] == s and size[d]) for s in sources}
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], smallest[s]) for s in sources)


def tilted(sizes, goal, cap=3.0):
    """Rates by bisection on the multiplier of sum(size * min(cap, exp(l * size / mean))) = goal."""
    x = np.array(sizes, float)
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        met = (x * np.minimum(cap, np.exp(np.minimum(mid * x / x.mean(), 700)))).sum()
        low, high = (mid, high) if met < goal else (low, mid)
    return np.minimum(cap, np.exp(np.minimum(high * x / x.mean(), 700)))


def test_rates_solve_the_dual(spark):
    rng = np.random.default_rng(5)
    rows = [(i, ("a", "b", "c")[i % 3], " ".join(["w"] * int(rng.lognormal(3, 1)))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    weights = spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 1.0)], "source string, weight double")
    got = mixing.mix(df, weights).collect()
    for s in "abc":
        mine = sorted((r for r in got if r.source == s), key=lambda r: r.doc_id)
        want = tilted([r["size"] for r in mine], mine[0].target)
        assert [r.rate for r in mine] == pytest.approx(list(want), rel=1e-5, abs=1e-7)
        # Copies of one size differ by one at most
        by_size = defaultdict(set)
        for r in mine:
            by_size[r["size"]].add(r.copies)
        assert all(max(v) - min(v) <= 1 for v in by_size.values())
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.001 * mine[0].target + 1


def test_mixture_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)  # sizes of many documents in slices
    monkeypatch.setattr(mixing, "AGAIN", 7)
    rows = [(i, "hot", "a b c", "x", 1) for i in range(400)] + [(1, None, "w " * 30, "x", 1)] * 40 + [(None, "z", None, "x", 1), (None, "z", "", "x", 1), (5, "one", "w " * 9000, "x", 1), (6, "", "q", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size string, rate int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    of = defaultdict(list)
    for r in got:
        of[r.source].append(r)
    total = sum(r["size"] for r in got)
    assert total == 1200 + 1200 + 9000 + 1 and sum(rs[0].target for rs in of.values()) == pytest.approx(total)
    for s, rs in of.items():
        assert {r.source_size for r in rs} == {sum(r["size"] for r in rs)}
        assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] for r in rs)
        assert max(r.copies for r in rs) - min(r.copies for r in rs) <= 1
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r["size"] for r in rs) / 2 + 1, s
    assert [r.taken for r in of["z"]] == [0, 0]
    none = mixing.mix(df, spark.createDataFrame([("hot", 1.0), ("one", None), (None, -1.0)], "source string, weight double")).collect()
    assert {r.source for r in none if r.taken} == {"hot"} and all(r.copies == 3 for r in none if r.source == "hot")
    assert not mixing.mix(df.limit(0)).collect()


# --- hard negatives


def plain_negatives(rows, chosen, low=80, high=100, k=5, scale=256):
    y = [(i, l, [math.floor(scale * x) for x in v]) for i, l, v in rows]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for i, l, v in {r[0]: r for r in sorted(y, reverse=True)}.values():
        if not chosen(i):
            continue
        scored = sorted({(-dot(v, w), j, m == l) for j, m, w in y if j != i})
        for p, j, _ in [s for s in scored if s[2]][:k]:
            fits = [(-s, n) for s, n, same in scored if not same and low * -p <= 100 * -s <= high * -p][:k]
            out += [(i, j, rank, n, -p, s) for rank, (s, n) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, *args, **kwargs):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, *args, **kwargs).collect())


@pytest.mark.parametrize("dimension, mean", [(1, 0.0), (5, 2.0), (64, 0.0), (130, 0.3)])
def test_hard_negatives(spark, dimension, mean, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST", 32)
    monkeypatch.setattr(hard_negatives, "ASKED", 8)
    rng = np.random.default_rng(dimension)
    centres = rng.normal(mean, 1, size=(6, dimension))
    rows = []
    for i in range(400):
        v = centres[i % 6] if i % 3 == 0 else centres[i % 6] + rng.normal(0, 0.4, dimension)  # a third are copies
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in v]))
    rows += rows[:20] + [(7, 1, rows[9][2])]  # repeated rows, and an id with two
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert mined(df, F.col("vec_id") % 20 == 0) == plain_negatives(rows, lambda i: i % 20 == 0)
    assert mined(df, F.col("vec_id") % 20 == 0, positives=2, negatives=2, low=30, high=90)[:1]


def test_intervals_hold_the_scores(spark):
    rng = np.random.default_rng(1)
    for d in (3, 64, 100):
        y = np.floor(rng.normal(0.2, 1, size=(500, d)) * 256)
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        coder = hard_negatives.Coder(256.0, np.median(y, axis=0), q)
        codes, aligned, rest = coder.code(y)
        a = hard_negatives.Anchors(coder, np.arange(50), np.zeros(50, np.int64), y[:50].astype(np.int32), [[(0, 0, 0)]] * 50, True, 5)
        ones = np.bitwise_count(codes).sum(axis=2).astype(float)
        estimate, off = a.intervals(slice(0, 50), codes, ones, aligned, rest)
        true = y[:50] @ y.T
        assert (np.abs(true - estimate) <= off).all()
        # They tell something: the error allowed is a part of the product of the lengths
        assert np.median(off / np.outer(np.linalg.norm(y[:50], axis=1), np.linalg.norm(y, axis=1))) < 0.25


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.0]), (3, 2, [0.9, 0.1]), (4, 2, None), (5, 2, []), (6, None, [1.0, 0.0]), (7, 2, [nan, 1.0]), (8, 2, [None, 1.0]), (None, 2, [0.9, 0.0]), (9, 2, [inf, 0.0]), (10, 2, [1e300, 0.0]), (11, 2, [1.0, 0.0, 0.0]), (12, 2, [0.0, 0.0]), (13, 1, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id bigint, label int, embedding array<double>, y string, rest double")
    # 256 * 256 and 256 * 230; the second positive's score is negative, so it has no negatives
    assert mined(df, F.col("vec_id") == 0) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 3, 65536, 58880)]
    assert not mined(df, F.col("vec_id") == 50)
    assert not mined(df.limit(0), F.col("vec_id") == 0)
    assert not mined(df.where("vec_id in (4, 5)"), F.col("vec_id") == 4)
