"""Defined results on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import chat, decontamination, language, near_dedup, packing, pii, sharding, token_counts, url_filter
from graphloom.llm.common import words_of
from graphloom.llm.decontamination import SuffixAutomaton
from graphloom.llm.tokens import PieceCounts, WordIds, tokenizer_path

from .test_queries import near_groups

LONG = "alpha beta gamma " * 40_000
ROWS = [
    (1, "the same text of more than five words", "en", "a", 1),
    (1, "the same text of more than five words", "en", "a", 1),
    (2, "The same, text of more than five words!", "en", "a", 1),
    (3, "", "en", None, 0),
    (4, None, None, "b", None),
    (None, "another text without an id at all here", "fr", "b", 3),
    (5, LONG, "en", "a", len(LONG)),
    (6, "%%% $$$", "de", "c", 7),
    (7, "one", "de", "c", 3),
    (8, "One!", "de", "c", 3),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns have names that operators might use within."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("key", "root", "spans", "bucket", "shard", "best", "prior", "masked", "cleaned", "text_key", "id_mark", "language"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "more than five words"), (2, None), (3, ""), (None, "alpha beta")], "item_id bigint, text string")


def test_all_operators_take_odd_rows(spark, odd, bench):
    model = language.fit(odd)
    results = [
        language.identify(odd, model),
        sharding.assign(odd),
        pii.digest(odd),
        packing.pack(odd).select("doc_id", "doc_tokens").distinct(),
        token_counts.count_tokens(odd),
        decontamination.overlaps(odd, bench),
        near_dedup.classes(odd),
    ]
    for k, df in enumerate(results):
        assert len(df.collect()) == (9 if k == 3 else len(ROWS)), k


def test_all_operators_take_empty_tables(spark, odd, bench):
    none = odd.limit(0)
    model = language.fit(odd)
    for df in (language.identify(none, model), sharding.assign(none), pii.digest(none), packing.pack(none), token_counts.count_tokens(none), decontamination.overlaps(none, bench), near_dedup.classes(none), near_dedup.deduplicate(none)):
        assert df.collect() == []
    assert all(not r.contaminated for r in decontamination.overlaps(odd, bench.limit(0)).collect())
    assert chat.digest(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
    empty = spark.createDataFrame([], "page_id bigint, url string, bad int")
    assert url_filter.judge(empty, empty).collect() == []


def test_stages_keep_columns(spark, odd, small):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert stage


def test_language_rejects_what_has_no_letters(spark, odd):
    model = language.fit(odd)
    assert sorted(r.doc_id for r in odd.join(language.accept(odd, model).select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id is not null").collect()) == [3, 4, 6]


def test_language_held_out(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    got = language.identify(docs.where("doc_id % 2 = 1"), model, declared=None)
    assert got.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0] >= 0.95


def test_dedup_keeps_one(spark, odd):
    kept = near_dedup.deduplicate(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]


def test_dedup_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 120))] * rng.choice([1, 1, 3])
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == near_groups(texts)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = near_dedup.mix(np.arange(1, 201, dtype=np.uint64))
    a = rng.integers(0, 9, 200)
    b = np.where(rng.random(200) < 0.3, rng.integers(0, 9, 200), a)
    owner = np.concatenate((np.zeros(a.sum(), int), np.ones(b.sum(), int)))
    s = near_dedup.signatures(owner, np.concatenate((np.repeat(h, a), np.repeat(h, b))), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_automaton_against_all_windows():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.choice([2, 3, 4])
        items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 7))]) for i in range(rng.randint(0, 5))]
        w = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 25))]
        hit, found = [False] * len(w), set()
        for name, words in items:
            m = min(n, len(words))
            for i in range(len(w) - m + 1) if m else ():
                if any(w[i : i + m] == words[j : j + m] for j in range(len(words) - m + 1)):
                    hit[i : i + m] = [True] * m
                    found.add(name)
        a = SuffixAutomaton(items, n)
        got, which = a.search(w)
        assert got.tolist() == hit and {a.names[k] for k in which} == found


def test_decontamination_removes_spans(spark, bench):
    filler = "a b c d e f g h"
    df = spark.createDataFrame([(1, f"{filler} More than, FIVE words. {filler}"), (2, "more than five words"), (3, filler), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in decontamination.remove(df, bench).collect()}
    assert got == {1: f"{filler} . {filler}", 3: filler, 4: None}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail john [at] example [dot] com now", ["john [at] example [dot] com"]),
        ("x.y at mail dot example dot org, yes", ["x.y at mail dot example dot org"]),
        ("call plus four four two zero seven nine four six zero nine five eight", ["plus four four two zero seven nine four six zero nine five eight"]),
        ("card " + "four " + "one " * 14 + "one", ["four " + "one " * 14 + "one"]),
        ("jоhn＠ехample．com", ["jоhn＠ехample．com"]),
        ("ip one nine two dot one six eight dot zero dot one.", ["one nine two dot one six eight dot zero dot one"]),
        ("meet me at example.com, look at this dot", []),
        ("", []),
        (None, []),
    ],
)
def test_disguises(text, want):
    assert [text[s:e] for _, s, e, _ in pii.find(text)] == want


AT = [" at ", " [at] ", "(at)", "@", " arroba ", " arobase ", " {arroba} ", " <Klammeraffe> ", " Klammeraffe "]
DOT = [" dot ", " [dot] ", "(dot)", ".", "[.]", " punto ", " Punkt ", "(punkt)", " point ", "[point]"]


@pytest.mark.parametrize("at", AT)
@pytest.mark.parametrize("dot", DOT)
def test_disguised_emails_of_mixed_forms(at, dot):
    """One dot, and two of them that differ. A spelled "at" needs more than literal dots, and a "point" before the last label; a base address keeps its own end."""
    rests = [(f"example{dot}com", {dot}), *((f"mail{dot}example{other}com", {dot, other}) for other in DOT)]
    for rest, dots in rests:
        if (at == " at " and (dots == {"."} or rest == "mail point example.com")) or (at == "@" and dot == "."):
            continue
        text = f"so: john{at}{rest}, yes"
        assert [text[s:e] for k, s, e, _ in pii.find(text) if k == "email"] == [f"john{at}{rest}"], text


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("john at a dot b [dot] c dot d dot e dot f (dot) g dot org now", "email", "john at a dot b [dot] c dot d dot e dot f (dot) g dot org"),
        ("appelez plus trois trois un deux trois quatre cinq six sept huit neuf", "phone", "plus trois trois un deux trois quatre cinq six sept huit neuf"),
        ("Anruf: plus vier neun null eins zwei drei vier FÜNF sechs sieben acht", "phone", "plus vier neun null eins zwei drei vier FÜNF sechs sieben acht"),
        ("llame más tres cuatro cero uno dos tres cuatro cinco seis siete ocho", "phone", "más tres cuatro cero uno dos tres cuatro cinco seis siete ocho"),
        ("ip zéro punto dos Punkt neuf point acht ok", "ip", "zéro punto dos Punkt neuf point acht"),
        ("carte quatre " + "un " * 14 + "une", "card", "quatre " + "un " * 14 + "une"),
    ],
)
def test_disguises_of_all_languages(text, kind, want):
    assert [(k, text[s:e]) for k, s, e, _ in pii.find(text)] == [(kind, want)]


@pytest.mark.parametrize("text", ["look at this point in time", "at that point the dot is at home", "un point, deux points", "arroba de trigo", "Punkt eins am Punkt zwei"])
def test_no_disguise(text):
    assert pii.find(text) == []


def test_piecewise_tokens_equal_the_library():
    rng = random.Random(1)
    parts = ["a", "The", "é", "é", " ", "  ", "\n", "\t", ".", ",", "...", "'s", "'", "İ", "Σ", "▁", "<|endoftext|>", "<|ENDOFTEXT|>", "</s>", "1", "😀", "́", "K", "<0x0A>", "\x00", "中", "-", "x.'s", "$$$"]
    words, pieces = WordIds(tokenizer_path("word_bpe_49k.json")), PieceCounts(tokenizer_path("piece_bpe_32k.model"))
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    # Tokens come out the same with caches that are new, full and overfull
    for cache in (words.cache, pieces.cache):
        cache.entries = 40
    texts += [None, "", " ", "   ", "\n", " \n\n", "   a   \n  b  ", "x" * 5000]
    for n in (len(texts), 7, 1):
        some = [texts[i : i + n] for i in range(0, 400 * n if n < 8 else len(texts), n)]
        got = [x.tobytes() for part in some for x in words.many(pa.array(part, pa.string()))]
        assert got == [words.encode(t or "") for part in some for t in part]
        got = [x for part in some for x in pieces.counts(pa.array(part, pa.string())).tolist()]
        assert got == [len(pieces.model.encode(t or "")) for part in some for t in part]
        assert len(words.cache.pieces) <= 40 and max(map(len, words.cache.pieces.to_pylist()), default=0) <= 48


def test_chat_round_trip(spark):
    said = ["<|user|>", "a\\p|b\\", "<|end|>", "\\", "|", None, "", "x" * 3000, "ends <", "<\\l<|"]
    rows = [(c, t, random.Random(c * 50 + t).choice(["user", "assistant", "system", "a|>\n", "b<", "<", "\\l", None]) if t else random.Random(c).choice(["system", "user"]), said[(c + t) % len(said)]) for c in range(6) for t in range(c * 5 + 1)]
    df = spark.createDataFrame([*rows, (None, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    w = chat.windows(df)
    back = {r.conv_id: r for r in chat.read_back(w).collect()}
    for c in range(6):
        mine = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert [(t.role, t.text) for t in back[c].turns] == mine
        assert list(back[c].loss) == [x for r, x in mine if r == "assistant"]
    assert w.count() > 7


def test_reputation_shrinks(spark):
    pages = [(k, f"http://bad.example.xyz/{k}") for k in range(40)] + [(100 + k, f"https://good.other.abc/{k}") for k in range(40)] + [(200, "http://new.example.xyz/a"), (201, None), (202, "no scheme"), (203, "HTTP://A.Example.COM/en/1?x")]
    labels = [(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(30)] + [(None, 1), (999, 1), (5, None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")).collect()}
    assert got[35].verdict == "block" and got[135].verdict == "allow" and got[200].verdict == "block"
    assert (got[201].host, got[201].path, got[202].host) == ("", "", "")
    assert (got[203].host, got[203].rule, got[203].verdict) == ("a.example.com", "com/en/", "block")
    assert got[35].bad_bound > got[200].bad_bound > got[135].bad_bound


def test_registered_domains(spark):
    """One label below co.uk says nothing of another name there; users and ports are no part of names."""
    pages = [(1, "http://shop.a.co.uk/x"), (2, "http://b.co.uk/y"), (3, "http://me@b.example.com:8080/z"), (4, "http://b.example.com/z"), (5, "https://co.uk/"), (6, "http://c.com/")]
    pages += [(100 + k, f"http://x{k}.a.co.uk/") for k in range(20)] + [(200 + k, f"http://y{k}.co.uk/") for k in range(300)]
    labels = [(100 + k, 1) for k in range(20)] + [(200 + k, 0) for k in range(300)] + [(3, 1)] * 3
    df = spark.createDataFrame([(*p, "x", 1.0) for p in pages], "page_id bigint, url string, name string, domain double")
    got = {r.page_id: r for r in url_filter.judge(df, spark.createDataFrame(labels, "page_id bigint, bad int")).collect()}
    assert got[1].verdict == "block" and got[2].verdict == "allow" and got[3].host == "me@b.example.com:8080"
    assert got[3].bad_bound == got[4].bad_bound > got[6].bad_bound


def test_packing_cells():
    rng = random.Random(2)
    pieces = [(k, 0, np.full(n, k, "<u4"), n) for k in range(200) if (n := rng.randint(1, 400))]
    total = sum(len(p[2]) for p in pieces)
    placed, left = packing.pack_cell(pieces, total // 512, 512)
    fill = [0] * (total // 512)
    for k, offset, p in placed:
        fill[k] += len(p[2])
        assert offset + len(p[2]) <= 512
    assert set(fill) == {512} and sum(len(p[2]) for p in left) == total % 512
    rest = packing.pack_rest(left, 512)
    assert sum(len(p[2]) for _, _, p in rest) == total % 512


def test_words():
    assert words_of("A-b É1\tx") == [b"a", b"b", "É1".encode(), b"x"]


def test_components_and_later_links_against_union_find(spark):
    rng = random.Random(5)
    keys = [bytes([i // 256, i % 256]) for i in range(400)]
    links = [(keys[rng.randrange(300)], keys[rng.randrange(300)]) for _ in range(160)] + [(keys[0], k) for k in keys[5:40]] + list(zip(keys[100:130], keys[101:131], strict=True))
    later = [(keys[3], keys[399]), (keys[120], keys[7]), (keys[350], keys[351]), (keys[351], keys[352])]

    def least(pairs):
        parent = {}

        def find(k):
            while parent.setdefault(k, k) != k:
                k = parent[k]
            return k

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        return {k: find(k) for k in parent}

    def rows(df):
        got = [(bytes(r.key), bytes(r.root)) for r in df.collect()]
        assert len(got) == len(set(got))
        return dict(got)

    first = spark.createDataFrame([p for p in links if p[0] != p[1]], "a binary, b binary")
    linked = near_dedup.components(first)
    assert rows(linked) == least([p for p in links if p[0] != p[1]])
    merged = near_dedup._merged(linked, spark.createDataFrame(later, "a binary, b binary"))
    assert rows(merged) == least([p for p in links if p[0] != p[1]] + later)
