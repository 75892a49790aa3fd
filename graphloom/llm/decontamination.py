"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The automaton of the items is built on the driver and broadcast. A task streams each document's words through it and tracks the
length of the longest match that ends at each word. A window is ``WINDOW`` consecutive words of an item, or the whole of a
shorter item; words inside any occurrence of a window are hit. A benchmark of more than ``PART_WORDS`` words is dealt into parts,
each with an automaton of its own; long items are cut so that every window lies in a piece as a whole. The parts are searched
for in turn, and what they find in a text is united.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_series, cut, fresh, text_key, tidy, words_of

WINDOW = 10
#: Words of the items in one automaton (some 700 bytes each in every worker, as measured), and first words of windows in a piece of an item.
PART_WORDS, PIECE_WORDS = 100_000, 4096
#: A document of which a larger share of words is hit is removed, else the hit spans alone.
MAX_COVERAGE = 0.5
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


class SuffixAutomaton:
    """Of several word sequences. A state stands for all sequences with the same end places in the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = sorted({name for name, words in items if words})
        number = {name: k for k, name in enumerate(self.names)}
        coded = [(number[name], [self.words.setdefault(w, len(self.words) + 1) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(c) for _, c in coded)])
        #: (length of a window, items) at the state that holds it.
        self.found: dict[int, dict[int, set[int]]] = {}
        for item, codes in coded:
            state = matched = 0
            for c in codes:
                state, matched = self.step(state, matched, c)
                if matched >= min(window, len(codes)):
                    n = min(window, len(codes))
                    at = state
                    while self.length[self.link[at]] >= n:
                        at = self.link[at]
                    self.found.setdefault(at, {}).setdefault(n, set()).add(item)
        self.above: dict[int, list[tuple[int, set[int]]]] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        state = self.next[state].get(c, -1)
        return (state, matched + 1) if state >= 0 else (0, 0)

    def windows(self, state: int) -> list[tuple[int, set[int]]]:
        """Windows that end where this state's sequences do: (words, items), from this state and those that it links to."""
        out = self.above.get(state)
        if out is None:
            out, at = [], state
            while at > 0:
                out += self.found.get(at, {}).items()
                at = self.link[at]
            self.above[state] = out
        return out

    def search(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Whether each word is hit, and the items with occurring windows."""
        hit, items = np.zeros(len(words), bool), set()
        get = self.words.get
        codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], codes > 0, [0]))))
        for begin, end in edges.reshape(-1, 2).tolist():  # a window holds item words alone
            if end - begin < self.shortest:
                continue
            state = matched = 0
            for i, c in enumerate(codes[begin:end].tolist(), begin):
                state, matched = self.step(state, matched, c)
                if matched >= self.shortest:
                    for n, which in self.windows(state):
                        if n <= matched:
                            hit[i + 1 - n : i + 1] = True
                            items |= which
        return hit, items


def pieces(benchmark: DataFrame, window: int = WINDOW, piece: int = PIECE_WORDS) -> DataFrame:
    """(name, words, n): each item's words, joined by spaces, in pieces that share window - 1 words. A null item_id is called "null"."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                rows += [(name, words[i : i + piece + window - 1]) for i in range(0, max(1, len(words) - window + 1), piece)] if words else []
            yield pa.RecordBatch.from_pydict({"name": pa.array([r[0] for r in rows], pa.string()), "words": pa.array([b" ".join(r[1]) for r in rows], pa.binary()), "n": pa.array([len(r[1]) for r in rows], pa.int32())})

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string")).where("text is not null")
    return rows.mapInArrow(tidy(cut_up), "name string, words binary, n int").distinct()


def automata(benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> Iterator[tuple[SuffixAutomaton, bool]]:
    """One for each part, built when it is asked for, and whether there are others."""
    rows = pieces(benchmark, window)
    parts = -(-(rows.agg(F.sum("n")).first()[0] or 0) // part_words)
    if parts > 1:
        rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("name", "words"), F.lit(parts))))
    for k in range(max(parts, 1)):
        mine = rows.where(F.col("part") == k) if parts > 1 else rows
        yield SuffixAutomaton(sorted((r.name, bytes(r.words).split(b" ")) for r in mine.collect()), window), parts > 1


def _spans(hit: np.ndarray) -> np.ndarray:
    """First and last word (exclusive) of each run of hit words."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))


def _found(docs: DataFrame, automaton: SuffixAutomaton) -> DataFrame:
    """(key, spans, items) of each different text that has hits: what one part finds, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hit, items = shared.value.search(words_of(text))
                if items:
                    rows.append((key, _spans(hit).tolist(), [shared.value.names[i] for i in items]))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())], strict=True)], names=["key", "spans", "items"])

    texts = docs.select(text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = cut(texts.mapInArrow(tidy(run), "key binary, spans array<int>, items array<string>").dropDuplicates(["key"]))
    shared.destroy()
    return found


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame | SuffixAutomaton:
    """The automaton, if one is enough; else (key, spans, items) of each text with hits, from all parts."""
    found = None
    for automaton, more in automata(benchmark, window, part_words):
        if not more:
            return automaton
        mine = _found(docs, automaton)
        found = mine if found is None else found.union(mine)
    # At most one row of each part for a text
    return found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _hits(words: int, spans: list[int]) -> np.ndarray:
    hit = np.zeros(words, bool)
    for begin, end in zip(spans[::2], spans[1::2], strict=True):
        hit[begin:end] = True
    return hit


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    Defined results: a null or wordless text has no words and no hits (the hash is that of an empty string); items without
    words have no windows; items of equal text each count; repeated rows and null doc_ids give a row each; an empty table of
    documents gives no rows, an empty benchmark no hits; other columns are ignored.
    """
    found = search(docs, benchmark, window, part_words)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if isinstance(found, SuffixAutomaton):
        shared = docs.sparkSession.sparkContext.broadcast(found)
    else:
        shared = None
        rows = rows.withColumn("key", text_key(F.col("text"))).join(found, "key", "left").select("doc_id", "text", "spans", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, str]] = []
            for k, text in enumerate(b.column(1).to_pylist()):
                words = words_of(text)
                if shared:
                    hit, items = shared.value.search(words)
                    names = sorted(shared.value.names[i] for i in items)
                else:
                    hit, names = _hits(len(words), b.column(2)[k].as_py() or []), sorted(b.column(3)[k].as_py() or [])
                out.append((len(words), int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    return rows.mapInArrow(tidy(run), "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, part_words: int = PART_WORDS) -> DataFrame:
    """The documents without the hit spans; one of which more than ``max_coverage`` of the words is hit goes as a whole.

    A span goes from its first word's first character to its last word's last one. Texts without hits, nulls among them, stay
    as they are, as do all other columns; n_chars, if there is such a column, follows the text.
    """

    def without(text: str, hit: np.ndarray) -> str | None:
        """None: the document goes."""
        if not hit.any():
            return text
        if hit.mean() > max_coverage:
            return None
        kept, at = [], 0
        spans = [m.span() for m in WORD.finditer(text)]
        for begin, end in _spans(hit).reshape(-1, 2).tolist():
            kept.append(text[at : spans[begin][0]])
            at = spans[end - 1][1]
        return "".join([*kept, text[at:]])

    new, key, spans, items = fresh(docs.columns, "cleaned", "text_key", "spans", "items")
    text = F.col("text").cast("string")
    found = search(docs, benchmark, window, part_words)
    if isinstance(found, SuffixAutomaton):
        shared = docs.sparkSession.sparkContext.broadcast(found)
        out = docs.withColumn(new, F.pandas_udf(by_series(lambda t: without(t, shared.value.search(words_of(t))[0]) if t else t), "string")(text))
    else:
        found = found.select(F.col("key").alias(key), F.col("spans").alias(spans))

        def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
            return pd.Series([t if s is None else without(t, _hits(len(words_of(t)), list(s))) for t, s in zip(texts, spans, strict=True)], dtype=object)

        # Only texts with hits are looked at again
        joined = docs.withColumn(key, text_key(F.col("text"))).join(found, key, "left")
        out = joined.withColumn(new, F.when(F.col(spans).isNull(), text).otherwise(F.pandas_udf(cleaned, "string")(text, F.col(spans))))
    out = out.where(F.col(new).isNotNull() | F.col("text").isNull())
    return out.select(*(F.col(new).alias(c) if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))
