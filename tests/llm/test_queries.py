"""Queries over the given tables against SQL, or against plain versions of what they compute."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, registry
from graphloom.llm.common import words_of
from graphloom.llm.tokens import tokenizer_path

from ..compare import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, small, name):
    columns, rows = spark_rows(registry.QUERIES[name](spark, small))
    want_columns, want = oracle(registry.SQL[name], small)
    assert columns == want_columns
    assert rows == want, (list((rows - want).items())[:2], list((want - rows).items())[:2])


@pytest.fixture(scope="module")
def docs(spark, small):
    return [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def run(spark, small, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, small).collect()]


def test_op1_agrees_with_declared(spark, small, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    got = run(spark, small, "op1_language_id")
    assert len(got) == len(docs)
    assert sum(r["language"] == lang[r["doc_id"]] for r in got) >= 0.98 * len(got)


def test_op2_shards(spark, small, docs):
    got = run(spark, small, "op2_proportional_shards")
    by_id = {d["doc_id"]: d for d in docs}
    assert sorted(r["doc_id"] for r in got) == sorted(by_id)
    shards = defaultdict(list)
    for r in got:
        raw = (by_id[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "rows")
        shards[r["shard"]].append(r)
    assert set(shards) == set(range(8))
    counts = [len(v) for v in shards.values()]
    assert max(counts) - min(counts) <= 1
    total = Counter(d["source"] for d in docs)
    for v in shards.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
        mine = Counter(r["source"] for r in v)
        assert all(abs(mine[s] - n / 8) <= 1.5 for s, n in total.items())
    # Plain version: fractional ranks of the seeded order within each source
    key = lambda d: (hashlib.md5(f"mix:{d['doc_id']}:{zlib.crc32((d['text'] or '').encode())}".encode()).hexdigest(), d["doc_id"])
    order = []
    for s in total:
        mine = sorted((d for d in docs if d["source"] == s), key=key)
        offset = zlib.crc32(f"mix={s}".encode()) % 4096 / 4096
        order += [((k + offset) / len(mine), "=" + s, *key(d)) for k, d in enumerate(mine)]
    n = len(order)
    want = {x[3]: (k * 8 // n, k - -(-(k * 8 // n) * n // 8)) for k, x in enumerate(sorted(order))}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want


BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def base_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                yield kind, m.start(), m.end()


def test_op3_base_spans(spark, small, docs):
    got = {r["doc_id"]: r for r in run(spark, small, "op3_personal_data")}
    assert len(got) == len(docs)
    for d in docs:
        want = list(base_spans(d["text"] or ""))
        r = got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(",")) | ({""} if not want else set())


def test_op4_recall(spark, small):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in sorted(run(spark, small, "op4_multiprobe_neighbours"), key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(math.dist(rows[r["query_id"]], rows[r["vec_id"]]), abs=1e-12)
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    found = 0
    for q in (i for i in rows if i % 100 == 0):
        want = sorted((math.dist(rows[q], v), i) for i, v in rows.items() if i != q)[:10]
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        found += len({i for _, i in want} & {i for _, i in got[q]})
    assert found >= 0.9 * 10 * len(got)


def test_op4_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got[:1] == [(0, 1, 1, 0.0)] and [g[2] for g in got] in ([1], [1, 7])
    assert not ann.search(df.limit(0), F.col("vec_id") == 0).collect()


def test_op4_all_candidates(spark):
    """With fewer than k candidates all are found, whatever their place; repeated rows take no other's place."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (4, [0.0, 0.0]), (7, [2.0, 0.0]), (9, [1000.0, -5.0])]
    df = spark.createDataFrame(rows + [(1, [1.0, 0.0])] * 12, "vec_id bigint, embedding array<float>")
    got = ann.search(df, F.col("vec_id").isin(0, 9), k=10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 7), (0, 3, 9), (9, 1, 7), (9, 2, 0), (9, 3, 1)]


def test_op4_mixed_norms(spark):
    """Long vectors, a hot cluster and a hot vector: every query has 10 rows, and most of its true neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64)) / 8
    for first, times in ((0, 3), (10, 5), (20, 10)):
        x[first:4000:130] *= times
    x[5:4000:4] = x[5] + 0.01 * rng.normal(size=x[5:4000:4].shape)
    x[7:4000:40] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    asked = [*range(0, 390, 130), *range(10, 400, 130), *range(20, 410, 130), *range(9, 109, 4), 7, 47, *range(3, 203, 20)]
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id").isin(asked)).orderBy("query_id", "rank").collect():
        assert r.score == pytest.approx(math.dist(x[r.query_id], x[r.vec_id]), abs=1e-12)
        got[r.query_id].append((r.score, r.vec_id))
    share = {}
    for q in asked:
        want = sorted((s, i) for i, s in enumerate(np.sqrt(((x - x[q]) ** 2).sum(axis=1))) if i != q)[:10]
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        share[q] = len({i for _, i in want} & {i for _, i in got[q]}) / 10
    assert sum(share.values()) >= 0.95 * len(asked)
    assert sum(share[q] for q in asked[:12]) >= 0.9 * 12


def test_op6_pieces(spark, small, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, small, "op6_balanced_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for d in docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(pieces[d["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + p["length"]]))
            at += p["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_op7_counts(spark, small, docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run(spark, small, "op7_token_counts")}
    assert got == {d["doc_id"]: (len((d["text"] or "").encode()), n := len(m.encode(d["text"] or "")), n > 4096) for d in docs}


def near_groups(texts):
    """Brute force: links of all pairs that share a shingle, and their components."""
    bags = {}
    for i, t in texts.items():
        w = words_of(t)
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    by = defaultdict(set)
    for i, b in bags.items():
        for s in b:
            by[s].add(i)
    for i, b in bags.items():
        for j in set().union(*(by[s] for s in b)) if b else ():
            if j < i:
                common = sum((b & bags[j]).values())
                if common >= 0.8 * (sum(b.values()) + sum(bags[j].values()) - common):
                    join(i, j)
    same = {}
    for i, t in texts.items():
        if t is not None:
            join(i, same.setdefault(t, i))
    return {i: find(i) for i in texts}


def test_op10_groups(spark, small, docs):
    want = near_groups({d["doc_id"]: d["text"] for d in docs})
    got = {r["doc_id"]: r["class_id"] for r in run(spark, small, "op10_bagminhash_dedup")}
    assert got == want
