"""Whole methods against plain versions: the fused posterior, parts of a benchmark, blocks of hot buckets, and the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import ann, decontamination, language, near_dedup, registry

from .test_queries import near_groups


def plain_posterior(rows, model, suffixes):
    """rows: (host, text, declared, suffix). Language and confidence of each, and whether it has letters, with no Spark in it."""
    names = [*model.languages, "und"]
    n, w, und = len(names), language.PRIOR_WEIGHT, language.UND_PRIOR
    even = [(1 - und) / (n - 1)] * (n - 1) + [und] if n > 1 else [1.0]
    ll = model.log_likelihoods([r[1] for r in rows])
    counts = {k: defaultdict(lambda: np.zeros(n)) for k in ("host", "domain", "suffix")}
    total = np.zeros(n)
    part = {"host": lambda h: h, "domain": lambda h: ".".join(h.split(".")[-2:]), "suffix": lambda h: h.split(".")[-1]}
    for r, x in zip(rows, ll, strict=True):
        if x.any():
            one = np.eye(n)[int(x.argmax())]
            total += one
            for k in counts:
                counts[k][part[k](r[0] or "")] += one

    def smoothed(c, prior):
        return (c + w * prior) / (c.sum() + w)

    out = []
    for (host, _, declared, suffix), x in zip(rows, ll, strict=True):
        own = {k: counts[k][part[k](host or "")] for k in counts}
        prior = np.array(even)
        if own["host"].sum():
            for c in (total - own["suffix"], own["suffix"] - own["domain"], own["domain"] - own["host"], own["host"]):
                prior = smoothed(c, prior)
        post = x + np.log(prior)
        for told, reliability in ((declared, language.DECLARED_RELIABILITY), (suffixes.get((suffix or "").lower()), language.SUFFIX_RELIABILITY)):
            told = (told or "").strip().lower()[:2]
            if told in model.languages:
                post = post + np.log([reliability if m == told else (1 - reliability) / max(n - 2, 1) for m in names])
        best = int(post.argmax())
        out.append((names[best], 1 / np.exp(post - post.max()).sum()) if x.any() else ("und", 0.0))
    return out


HOSTS = ["a.x.de", "b.x.de", "c.y.de", "d.z.fr", "src1", "src2", "", None, "q.co"]


def test_posterior_against_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.fit(docs, rows=20)
    rng = random.Random(1)
    texts = [(r.text or "")[: rng.choice([12, 30, 400])] for r in docs.limit(150).collect()] + ["", "123 !?", None, "ж щ"]
    rows = [(rng.choice(HOSTS), t, rng.choice(["de", "FR-x", " en", None, "xx"]), rng.choice(["de", "UK", None, "zz"])) for t in texts]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, host string, text string, lang string, suffix string")
    want = plain_posterior(rows, model, language.SUFFIX_LANGUAGES)
    for columns in (None, ["doc_id"]):
        got = language.identify(df, model, host="host", suffix="suffix", columns=columns).collect()
        assert {r.doc_id: (r.language, round(r.confidence, 6)) for r in got} == {k: (a, round(b, 6)) for k, (a, b) in enumerate(want)}


def test_language_without_labels(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    for rows in ([], [(1, "some text", None, "a"), (2, None, "en", None)]):
        df = spark.createDataFrame(rows, schema)
        model = language.fit(df)
        assert model.languages == []
        assert [(r.language, r.accepted) for r in language.identify(df, model).collect()] == [("und", False)] * len(rows)
        assert language.accept(df, model).count() == 0


def test_rare_language_is_learnt(spark, small):
    """Few labelled rows of a script of its own, and one document that is repeated more often than the sample is large."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10_000 + k, f"слова {k} на другом языке и другие слова", "ru") for k in range(4)] + [(5, "always the same", "en")] * 300, docs.schema)
    model = language.fit(docs.union(rare), rows=40)
    assert "ru" in model.languages
    got = language.identify(spark.createDataFrame([(1, "другие слова на языке", "x")], "doc_id bigint, text string, source string"), model, declared=None).first()
    assert (got.language, got.accepted) == ("ru", True)


def test_language_of_pages(spark, small):
    """The pages' declared language stands for the truth of what the texts say; most agree, and the query gives what the operator does."""
    got = {r.page_id: r for r in registry.QUERIES["language_of_pages"](spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert sorted(got) == sorted(p.page_id for p in pages)
    model = language.fit(spark.read.parquet(f"{small}/documents.parquet"))
    evidence = language.page_evidence(spark.read.parquet(f"{small}/pages.parquet")).collect()
    want = plain_posterior([(r.host, r.text, r.lang, r.suffix) for r in evidence], model, language.SUFFIX_LANGUAGES)
    for r, (name, confidence) in zip(evidence, want, strict=True):
        assert got[r.page_id].language == name and got[r.page_id].confidence == pytest.approx(confidence, abs=2e-6)
    odd = spark.createDataFrame([(1, None, None), (2, "no address", ""), (3, "http://h.de/", "<html lang=de><script>x</script>und der")], "page_id bigint, url string, html string")
    assert [(r.text is None, r.lang, r.host) for r in language.page_evidence(odd).orderBy("page_id").collect()] == [(True, None, None), (False, None, ""), (False, "de", "h.de")]


def test_benchmark_in_parts(spark, small):
    """A benchmark of many parts and cut items gives what one automaton does."""
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    long = bench.agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).select(F.lit(-1).cast("bigint").alias("item_id"), "text")
    bench = bench.union(long)
    docs = docs.union(docs.limit(20)).unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (7, "", "en", "s", 0)], docs.schema))
    n = decontamination.pieces(bench, piece=64).agg(F.sum("n")).first()[0]
    assert n > 3000
    key = lambda r: tuple((x is None, x) for x in r)
    for f in (decontamination.overlaps, decontamination.remove):
        one, many = (sorted(f(docs, bench, part_words=k).collect(), key=key) for k in (10**9, n // 5))
        assert one == many and len(one) > 100
    assert any(r.contaminated for r in decontamination.overlaps(docs, bench, part_words=n // 5).collect())


def test_cut_items_keep_their_windows(spark):
    words = [f"w{i}" for i in range(50)]
    bench = spark.createDataFrame([("a", " ".join(words)), ("b", "w1 w2"), ("c", " "), ("d", None)], "item_id string, text string")
    got = [(r.name, bytes(r.words).decode().split()) for r in decontamination.pieces(bench, 10, 8).collect()]
    windows = {tuple(w[i : i + 10]) for name, w in got if name == "a" for i in range(len(w) - 9)}
    assert windows == {tuple(words[i : i + 10]) for i in range(41)}
    assert sorted(n for n, _ in got) == ["a"] * 6 + ["b"]


def test_hot_bucket_in_blocks(spark, monkeypatch):
    """Many texts around the threshold share buckets; dealt into blocks of a few rows they give the groups of brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        texts[len(texts)] = " ".join(w)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == near_groups(texts)


def test_neighbours_in_blocks(spark, monkeypatch):
    """With parts and blocks of a few rows, each query meets what it does in one block."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    x[::3] = x[0] + 0.01 * rng.normal(size=x[::3].shape)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")

    def got():
        return sorted(map(tuple, ann.search(df, F.col("vec_id") % 7 == 0).collect()))

    whole = got()
    for name, value in (("PART_ROWS", 500), ("BLOCK", 60), ("ASKED", 30), ("PART", 16)):
        monkeypatch.setattr(ann, name, value)
    assert got() == whole
    rows = {r.vec_id: r.embedding for r in df.collect()}
    for q, rank, v, score in whole:
        assert score == pytest.approx(math.dist(rows[q], rows[v]), abs=1e-12) and 1 <= rank <= 10


def test_pipeline_runs_all_stages(spark, small):
    """Every stage's decisions take effect in what ``run`` gives, over whole tables."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    packed = corpus_pipeline.run(spark, small).collect()
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
    for mine in pieces.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == mine[0].doc_tokens
    groups = near_groups({k: r.text for k, r in docs.items()})
    accepted = {r.doc_id for r in registry.QUERIES["op1_language_id"](spark, small).where("accepted").collect()}
    kept = set(pieces)
    assert kept <= accepted
    per_group = Counter(groups[k] for k in kept)
    assert max(per_group.values()) == 1
    wordy = [k for k in accepted if docs[k].text and re.search(r"\w", docs[k].text)]
    hit = {r.doc_id for r in registry.QUERIES["op8_decontamination"](spark, small).where("contaminated").collect()}
    missing = {groups[k] for k in wordy} - set(per_group)
    assert missing <= {groups[k] for k in hit}, "a group without a document left was mostly benchmark"
