"""Near-duplicate documents by BagMinHash signatures of their word shingles, banding and exact verification.

A document is a bag of five-word shingles. Its signature comes from Poisson processes over time and discretised weight: each
shingle has a process for every block of a dyadic hierarchy of weights, [0,1), [1,2), [2,4), [4,8) and so on, whose rate is the
block's width. Points come in order of time; those above the shingle's weight are thinned out; the others fall into a register,
which keeps its earliest point. A process ends once it is later than the document's latest register, so most take one or two
points. The chance that two documents share a register's point is their weighted Jaccard similarity.

Exact copies are one text from the start. Texts that share a bucket of a band are linked to its hubs, of which each bucket has
two, and verified on their whole bags. Pairs that are left (in one bucket, not linked so far by any path) are verified as well,
unless the distances to a hub, by the triangle inequality, rule the pair out. So a group of copies costs links in proportion to
its size, and no link that the bands find is lost. Groups are the connected components of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, cut, fitted, fresh, held, text_key, tidy

SHINGLE, SIMILARITY = 5, 0.8
#: Two texts of similarity 0.8 share no band with a chance of (1 - 0.8**6)**32 = 6e-5.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Keys of 16 bytes up to which a set of them is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 400_000
CHUNK = 1 << 18
#: Members of a bucket in a block of those that are compared in one task.
BLOCK = 512

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose result looks random."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    up, down = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of every shingle of these texts, whose bytes are already those of ``WORD_BYTES``.

    A text of fewer than five words, but not none, is one shingle.
    """
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    buf = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    if not _POWERS or len(_POWERS[0][0]) < len(buf):
        _POWERS[:] = [_powers(max(len(buf), CHUNK + (1 << 17)))]
    up, down = (p[: len(buf)] for p in _POWERS[0])
    edges = np.flatnonzero(np.diff((buf != 32).view(np.int8)))
    begins, ends = edges[::2], edges[1::2]  # the bytes before a word's first and at its last
    total = np.cumsum(_BYTE[buf] * up)
    words = mix((total[ends] - total[begins]) * down[begins])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    mine = np.concatenate((owner, np.full(SHINGLE, -1)))
    n = len(words)
    acc = words * _PLACES[0]
    for j in range(1, SHINGLE):
        acc = acc + np.where(mine[j : j + n] == owner, padded[j : j + n], _U(0)) * _PLACES[j]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    place = np.arange(n) - first[owner]
    full = (place + SHINGLE <= counts[owner]) | (place == 0)
    return owner[full], mix(acc[full])


def bags(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, hash, occurrence from 0) of every shingle, by number, then hash."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    return owner, h, np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))


def signatures(owner: np.ndarray, h: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The earliest point in each register of each of n texts; infinite without shingles."""
    owner, h, nth = bags(owner, h)
    last = np.ones(len(h), bool)
    last[:-1] = nth[1:] == 0
    owner, h, weight = owner[last], h[last], nth[last] + 1
    parts = [(owner, mix(h), np.ones(len(h)), np.ones(len(h)))]
    width = 1
    while (more := weight > width).any():  # the block [width, 2 * width)
        owner, h, weight = owner[more], h[more], weight[more]
        parts.append((owner, mix(h + _U(width * _BASE & (1 << 64) - 1)), np.full(len(h), float(width)), np.minimum(weight - width, width).astype(float)))
        width *= 2
    who, seed, rate, limit = (np.concatenate(p) for p in zip(*parts, strict=True))
    out = np.full(n * registers, np.inf)
    time, step, block = np.zeros(len(who)), 0, 1
    while len(who):
        k = np.arange(step, step + block, dtype=np.uint64)
        a = mix(seed[:, None] + (k * _U(2) + _U(1))[None, :] * _GOLD)
        at = time[:, None] + np.cumsum(-np.log(((a >> _U(11)) + _U(1)) * 2.0**-53), axis=1) / rate[:, None]
        time = at[:, -1]
        b = mix(a + _GOLD)
        register = ((b >> _U(32)) * _U(registers)) >> _U(32)
        below = np.floor((b & _U(0xFFFFFFFF)) * 2.0**-32 * rate[:, None]) < limit[:, None]
        below &= at <= out.reshape(n, registers).max(axis=1)[who][:, None]
        np.minimum.at(out, (who[:, None] * registers + register.astype(np.int64))[below], at[below])
        going = time <= out.reshape(n, registers).max(axis=1)[who]
        who, seed, rate, limit, time = who[going], seed[going], rate[going], limit[going], time[going]
        step, block = step + block, min(2 * block, 64) if step else 1
    return out.reshape(n, registers)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A hash for each band of each text, as signed integers. Single precision makes it the same on all machines."""
    s = np.ascontiguousarray(signature.astype(np.float32)).view(np.uint32).astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, s.shape[:2])
    for j in range(ROWS):
        acc = mix(acc ^ s[:, :, j]) + _U(j)
    return acc.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Keys and texts, in chunks of about CHUNK bytes."""
    keys: list[bytes] = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = text.as_py().encode().translate(WORD_BYTES)
            keys.append(key)
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _chunks(batches):
        owner, h = shingles(texts)
        some = np.unique(owner)
        got = bands_of(signatures(np.searchsorted(some, owner), h, len(some)))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * BANDS, BANDS), pa.int32()), pa.array(got.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), flat], names=["key", "bands"])


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _chunks(batches):
        owner, h, nth = bags(*shingles(texts))
        h = mix(h ^ (nth.astype(np.uint64) * _GOLD)).view(np.int64)
        offsets = np.searchsorted(owner, np.arange(len(keys) + 1))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h))], names=["key", "bag"])


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in links (a, b): the least key of its connected component, by stars that grow and shrink."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before, now = None, _state(edges)
    while now != before:
        edges = fitted(edges, now[0])
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = fitted(large.union(least.where("m < u").select("u", "m")), now[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = cut(fitted(small, now[0]).distinct())
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple[int, int | None]:
    """Number and checksum: equal once a round has changed nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _merged(linked: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``linked`` (key, root) after further links (a, b): only roots that these touch are looked at again."""
    of = [linked.select(F.col("key").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    ends = more.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = cut(components(ends))
    old = linked.join(moved.select(F.col("key").alias("root"), F.col("root").alias("now")), "root", "left").select("key", F.coalesce("now", "root").alias("root"))
    return old.union(moved.join(linked, "key", "left_anti"))


def _distance(a: str, b: str) -> Column:
    """1 - similarity, as 2 - (|a| + |b|) / |a or b|: the common part stands in it once."""
    together = F.size(a) + F.size(b)
    return 2 - together / F.size(F.array_union(a, b))


def _verified(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """(a, b, d): the weighted Jaccard distance of each pair of keys."""
    left = bag.select(F.col("key").alias("a"), F.col("bag").alias("bag_a"))
    right = bag.select(F.col("key").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", _distance("bag_a", "bag_b").alias("d"))


def roots(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, root) of every text that has a near copy of other words or letters: root is one key of its group."""
    text = F.col("text").cast("string")
    keyed = docs.where(text.isNotNull()).select(text_key(text).alias("key"), text.alias("text"))
    # One row a text is kept and shuffled here; its BANDS rows are made where they are used
    signed = cut(keyed.mapInArrow(tidy(_banded), "key binary, bands array<bigint>").dropDuplicates(["key"]))
    members = signed.select("key", F.explode(F.array_distinct("bands")).alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).where("n > 1")
    members = cut(members.join(buckets, "bucket"))
    starred = [members.where(f"key != {hub}").select(F.least("key", hub).alias("a"), F.greatest("key", hub).alias("b")) for hub in ("low", "high")]
    pairs = starred[0].union(starred[1]).distinct()
    involved = held(members.select("key").distinct(), BROADCAST_KEYS)
    bag = cut(keyed.join(involved, "key", "left_semi").mapInArrow(tidy(_bagged), "key binary, bag array<bigint>").dropDuplicates(["key"]))
    tested = cut(_verified(pairs, bag))
    near = F.col("d") <= 1 - similarity + 1e-12
    linked = cut(components(tested.where(near)))

    def to_hub(hub: str) -> DataFrame:
        """What the test of each member against a hub gave, by bucket."""
        return tested.select(F.col("a"), F.col("b"), F.col("d").alias(f"d_{hub}")), F.least("key", hub), F.greatest("key", hub)

    known = members.join(linked, "key", "left").withColumn("root", F.coalesce("root", "key"))
    split = known.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    known = known.join(split, "bucket").where("n > 2")
    for hub in ("low", "high"):
        table, a, b = to_hub(hub)
        known = known.withColumn("a", a).withColumn("b", b).join(table, ["a", "b"], "left").withColumn(f"d_{hub}", F.coalesce(f"d_{hub}", F.lit(0.0))).drop("a", "b")
    known = cut(known.where("key != low and key != high"))
    # Whatever lies in another group than its bucket's largest one meets all members; two of that one are linked already;
    sizes = known.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    # a bucket of many members is dealt into blocks, each of which all that lies apart reaches
    main = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks"))
    shared = known.groupBy("key").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))  # at most BANDS
    known = known.join(shared, "key").join(bag.select("key", F.transform("bag", lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - (1 << 31)).cast("int")).alias("bag")), "key").join(main, "bucket").withColumn("apart", F.col("root") != F.col("main"))
    apart = known.where("apart").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    known = known.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    sides = ("key", "root", "d_low", "d_high", "buckets", "bag")
    apart = apart.select(F.col("bucket").alias("x_bucket"), F.col("block").alias("x_block"), *[F.col(c).alias(f"x_{c}") for c in sides])
    once = (~F.col("apart") | (F.col("x_key") < F.col("key"))) & (F.get(F.array_intersect("buckets", "x_buckets"), F.lit(0)) == F.col("bucket"))
    bound = 1 - similarity + 1e-9
    may_be_near = (F.abs(F.col("d_low") - F.col("x_d_low")) <= bound) & (F.abs(F.col("d_high") - F.col("x_d_high")) <= bound)
    # The bags are compared within the join, so that only links leave it. 32 bits of each hash are enough here: where two meet
    # by chance, the distance only seems smaller, and what leaves the join is verified in full
    links = known.join(apart, (F.col("bucket") == F.col("x_bucket")) & (F.col("block") == F.col("x_block")) & (F.col("root") != F.col("x_root")) & may_be_near & once & (_distance("bag", "x_bag") <= bound))
    links = cut(links.select(F.least("key", "x_key").alias("a"), F.greatest("key", "x_key").alias("b")))
    more = cut(_verified(links, bag).where(near))
    if more.isEmpty():
        return linked
    return _merged(linked, more)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group) and class_size of every document.

    Documents are in one group if a path of texts that are equal or similar (0.8 or more, as bags of five-word shingles; fewer
    than five words are one shingle) joins them. Defined results: texts without words are in a group with equal ones alone, the
    empty text among them; each null text is a group of its own; rows with the same doc_id and text are two members of a group;
    null doc_ids count after all others; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"))
    roots_ = roots(docs, similarity)
    grouped = rows.where("key is not null").join(roots_, "key", "left").withColumn("root", F.coalesce("root", "key"))
    groups = grouped.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = rows.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return grouped.join(groups, "root").select("doc_id", "class_id", "class_size").union(alone)


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns: that of the least doc_id, then text. Null texts all stay."""
    columns = docs.columns
    key, mark, root = fresh(columns, "text_key", "id_mark", "root")
    keyed = docs.withColumn(key, text_key(F.col("text"))).withColumn(mark, F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)))
    first = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(mark).alias(mark))
    first = first.join(roots(docs, similarity).withColumnsRenamed({"key": key, "root": root}), key, "left").withColumn(root, F.coalesce(root, key))
    best = first.groupBy(root).agg(F.min(F.struct(mark, key)).alias("best")).select(F.col(f"best.{mark}").alias(mark), F.col(f"best.{key}").alias(key))
    best = cut(best)
    rows = keyed.where(F.col(key).isNotNull()).groupBy(key, mark).agg(F.count("*").alias("n"))
    gone = cut(rows.join(best.withColumn("stays", F.lit(True)), [key, mark], "left").where("stays is null or n > 1"))
    few = gone.count() <= BROADCAST_KEYS
    if few and gone.where("stays").isEmpty():  # no text needs to be shuffled
        kept = keyed.where(F.col(key).isNotNull()).join(F.broadcast(gone.select(key, mark)), [key, mark], "left_anti")
    else:
        kept = keyed.join(best, [key, mark], "left_semi").dropDuplicates([key, mark])
    return kept.select(*[F.col(f"`{c}`") for c in columns]).unionByName(docs.where(F.col("text").isNull()))
