"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` hash tables cuts ``HASHES`` Gaussian projections into cells. A query visits its own bucket and perturbed ones
in the order of their estimated chance of success: the least sum of squared distances to the cell borders that are crossed.
Buckets are dealt into parts; a vector or a query goes once to each part that has a bucket of it, with the list of these. A part
of many vectors or queries is dealt out in blocks, where each block of vectors meets each block of queries. Within a task, exact
distances are taken from the original vectors, and each query keeps its best candidates; those of all tasks are then merged.

The chance to meet a vector depends on its distance in cell widths alone. So a query whose k-th neighbour found lies beyond
``REACH`` widths, or that found fewer than k, goes on: through wider cells where the first ones were fitted to close neighbours,
then through an exact scan of all vectors, in blocks of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, held

TABLES, HASHES, PROBES, SEED = 5, 8, 300, 7
#: Width of a cell, in root mean squares of the vectors' distance from their mean, or in the distances of their k-th neighbours
#: where these are less; all taken from at most SAMPLE vectors. Of two widths closer than NARROW, only the first is used.
WIDTH, SAMPLE, NARROW = 2.0, 2000, 0.7
#: So many widths away, a vector is met with a chance of 0.9 (simulated for the numbers above: 0.92 at 0.6, 0.85 at 0.65).
REACH = 0.62
#: Bytes of the queries in a block of the exact scan, and vectors and queries whose distances are held at once.
SCANNED, PART = 1 << 25, 1024
#: Rows that a part has on average if all vectors are alike spread, and vectors and queries in a block.
PART_ROWS, BLOCK, ASKED = 1 << 16, 1 << 14, 1 << 15
#: Parts up to which the numbers of their blocks are broadcast.
PARTS = 500_000
FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass
class Hashing:
    mean: np.ndarray
    directions: np.ndarray  # tables x dimensions x hashes
    shifts: np.ndarray
    width: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Places in units of cells: tables x vectors x hashes."""
        return np.einsum("nd,tdk->tnk", x - self.mean, self.directions) / self.width + self.shifts[:, None, :]


def _code(table: int, cells: np.ndarray) -> np.ndarray:
    """A 64-bit bucket code of rows of cell numbers."""
    acc = np.full(len(cells), table + 1, np.uint64)
    for j in range(cells.shape[1]):
        acc = (acc ^ cells[:, j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc.view(np.int64)


def perturbations(place: np.ndarray, probes: int) -> np.ndarray:
    """Changes of the cell numbers, the likeliest first; the first is none."""
    k = len(place)
    gap = np.concatenate((place, 1 - place)) ** 2
    order = np.argsort(gap, kind="stable")
    z = gap[order]
    out, heap = [np.zeros(k, np.int64)], [(z[0], (0,))]
    while heap and len(out) < probes:
        score, chosen = heapq.heappop(heap)
        which = [int(order[i]) for i in chosen]
        if len({i % k for i in which}) == len(which):
            d = np.zeros(k, np.int64)
            for i in which:
                d[i % k] = -1 if i < k else 1
            out.append(d)
        if (m := chosen[-1]) + 1 < 2 * k:
            heapq.heappush(heap, (score + z[m + 1], (*chosen, m + 1)))
            heapq.heappush(heap, (score - z[m] + z[m + 1], (*chosen[:-1], m + 1)))
    return np.array(out)


def sound(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): the vectors that take part, as floats if they are, else in double precision; distances are always double."""
    kind = vectors.schema[vector].dataType
    v = F.col(f"`{vector}`").cast("array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def fit(rows: DataFrame, k: int) -> list[Hashing]:
    """One for each round, from at most SAMPLE vectors, those of the smallest id hashes; none without any."""
    got = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    if not got:
        return []
    dimension = max(sorted({len(v) for v in got}), key=lambda d: sum(len(v) == d for v in got))
    x = np.array([v for v in got if len(v) == dimension], dtype=np.float64)
    rng = np.random.default_rng(SEED)
    scale = float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
    directions, shifts = rng.normal(size=(TABLES, dimension, HASHES)), rng.uniform(0, 1, size=(TABLES, HASHES))
    near = _near(np.unique(x, axis=0), k)
    scales = [near] if NARROW * scale <= near < scale else [near, scale] if 0 < near < scale else [scale]
    return [Hashing(x.mean(axis=0), directions, shifts, WIDTH * s) for s in scales]


def _near(x: np.ndarray, k: int) -> float:
    """The median distance of the k-th neighbours of different vectors; 0 with too few of them."""
    if len(x) <= k:
        return 0.0
    square = (x**2).sum(axis=1)
    found = [np.partition(square[i] + square - 2 * (x[i] @ x.T), k)[k] for i in range(len(x))]
    return float(np.sqrt(max(np.median(found), 0.0)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _hashed(shared, parts: int, probing: bool):
    """Rows (vec_id, v) as (part, vec_id, v, codes): one for each part with a bucket of it, or, probing, one that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = shared.value
        for whole in batches:
            for at in range(0, len(whole), 256 if probing else 1024):
                b = whole.slice(at, 256 if probing else 1024)
                places = hashing.cells(_matrix(b.column(1)).astype(np.float64))
                cells = np.floor(places).astype(np.int64)
                codes, owners = [], []
                for t in range(len(cells)):
                    if probing:
                        moves = [c + perturbations(p - c, PROBES) for c, p in zip(cells[t], places[t], strict=True)]
                        owners.append(np.repeat(np.arange(len(moves)), [len(m) for m in moves]))
                        codes.append(_code(t, np.concatenate(moves)))
                    else:
                        owners.append(np.arange(len(b)))
                        codes.append(_code(t, cells[t]))
                code, owner = np.concatenate(codes), np.concatenate(owners)
                part = (code.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((part, owner))
                code, owner, part = code[order], owner[order], part[order]
                first = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(part) != 0)])
                lists = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(code)], pa.int32()), pa.array(code))
                mine = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), b.column(0).take(mine), b.column(1).take(mine), lists], names=["part", "vec_id", "v", "codes"])

    return run


_KIND = np.dtype([("score", "f8"), ("id", "i8")])


class _Best:
    """The k nearest of each of some queries, among vectors that come in blocks."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k, self.square = ids, q, k, (q**2).sum(axis=1)
        self.held, self.worst = [np.zeros(0, _KIND)] * len(ids), np.full(len(ids), np.inf)

    def meet(self, vec_id: np.ndarray, v: np.ndarray, met=None) -> None:
        """``met``: for a slice of the queries, which of them (rows) meet which vectors (columns); None: all do."""
        own = (v**2).sum(axis=1)
        for first in range(0, len(self.ids), PART):
            here = slice(first, first + PART)
            about = self.square[here, None] + own - 2 * (self.q[here] @ v.T)
            slack = 1e-9 * (self.square[here] + own.max())  # rounding of the product; distances themselves are taken anew
            near = ~(about > (self.worst[here] ** 2 + slack)[:, None])
            if met is not None:
                near &= met(here)
            for i in np.flatnonzero(near.any(axis=1)):
                self._keep(first + i, np.flatnonzero(near[i]), about[i], slack[i], vec_id, v)

    def _keep(self, n: int, mine: np.ndarray, about: np.ndarray, slack: float, vec_id: np.ndarray, v: np.ndarray) -> None:
        k = self.k
        if len(mine) > 4 * k:  # one id may come in several rows, so none is cut by count before ids are told apart
            order = mine[np.argsort(about[mine], kind="stable")]
            _, once = np.unique(vec_id[order], return_index=True)
            once = np.sort(once[vec_id[order][once] != self.ids[n]])
            mine = order if len(once) < k else mine[~(about[mine] > about[order[once[k - 1]]] + 2 * slack)]
        found = np.zeros(len(mine), _KIND)
        found["score"], found["id"] = np.sqrt(((v[mine] - self.q[n]) ** 2).sum(axis=1)), vec_id[mine]
        f = np.sort(np.concatenate((self.held[n], found[found["id"] != self.ids[n]])), order=["score", "id"])
        self.held[n] = f[np.sort(np.unique(f["id"], return_index=True)[1])[:k]]
        if len(self.held[n]) == k:
            self.worst[n] = self.held[n]["score"][-1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        f = np.concatenate([np.zeros(0, _KIND), *self.held])
        if len(f):
            owner = np.repeat(self.ids, [len(x) for x in self.held])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.ascontiguousarray(f["id"])), pa.array(np.ascontiguousarray(f["score"]))], names=["query_id", "vec_id", "score"])


def _rerank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by part, blocks and kind: a block's queries, then its vectors."""
        here, asked, best = None, [], None
        codes = owners = np.zeros(0, np.int64)
        for whole in batches:
            place = np.stack([whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            runs = np.flatnonzero(np.r_[True, (np.diff(place, axis=0) != 0).any(axis=1)])
            for begin, end in zip(runs, [*runs[1:], len(whole)], strict=True):
                key, is_vector = tuple(place[begin, :3]), place[begin, 3]
                if key != here:
                    if best:
                        yield from best.rows()
                    here, asked, best = key, [], None
                if not is_vector:
                    asked.append(whole.slice(begin, end - begin))
                    continue
                if not asked and not best:
                    continue
                if not best:
                    b = pa.Table.from_batches(asked).combine_chunks()
                    ids, q, lists = (b.column(i).combine_chunks() for i in (4, 5, 6))
                    best, asked = _Best(ids.to_numpy(zero_copy_only=False), _matrix(q).astype(np.float64), k), []
                    owners = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
                    codes = lists.flatten().to_numpy(zero_copy_only=False)
                    order = np.argsort(codes, kind="stable")
                    codes, owners = codes[order], owners[order]
                for at in range(begin, end, PART):
                    b = whole.slice(at, min(PART, end - at))
                    mine = b.column(6).flatten().to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(b)), np.diff(b.column(6).offsets.to_numpy()))
                    low, high = np.searchsorted(codes, mine, side="left"), np.searchsorted(codes, mine, side="right")
                    some = high > low
                    low, row, n = low[some], row[some], (high - low)[some]

                    def met(part: slice, low=low, row=row, n=n, size=len(b)) -> np.ndarray:
                        out = np.zeros((min(part.stop, len(best.ids)) - part.start, size), bool)
                        for first in range(0, len(n), 256):
                            few = n[first : first + 256]
                            ends = np.cumsum(few)
                            who = owners[np.repeat(low[first : first + 256] - (ends - few), few) + np.arange(ends[-1])]
                            which = np.repeat(row[first : first + 256], few)
                            inside = (who >= part.start) & (who < part.stop)
                            out[who[inside] - part.start, which[inside]] = True
                        return out

                    best.meet(b.column(4).to_numpy(zero_copy_only=False), _matrix(b.column(5)).astype(np.float64), met)
        if best:
            yield from best.rows()

    return run


def _scan(shared, k: int):
    """For ``mapInArrow``: the k nearest of a block of queries among a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, k)
        for whole in batches:
            for at in range(0, len(whole), PART):
                b = whole.slice(at, PART)
                best.meet(b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1)).astype(np.float64))
        yield from best.rows()

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest, by rank, of all that was found."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def _round(indexed: DataFrame, asked: DataFrame, shared, k: int, rows: int) -> DataFrame:
    """What the queries find in the buckets that they visit."""
    parts = max(1, round(rows * TABLES / PART_ROWS))
    kinds = f"part int, vec_id bigint, v {indexed.schema['v'].dataType.simpleString()}, codes array<bigint>"
    both = [df.mapInArrow(_hashed(shared, parts, probing), kinds).withColumn("is_vector", F.lit(not probing)) for df, probing in ((asked, True), (indexed, False))]
    both = both[0].union(both[1])
    n = lambda kind, size: F.greatest(F.ceil(F.count_if(kind) / size), F.lit(1)).cast("int")
    blocks = both.groupBy("part").agg(n(F.col("is_vector"), BLOCK).alias("v_blocks"), n(~F.col("is_vector"), ASKED).alias("q_blocks"))
    dealt = both.join(held(blocks, PARTS), "part")
    own = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.col(blocks)).cast("int")
    each = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    v_block = F.explode(F.when(F.col("is_vector"), F.array(own("v_blocks"))).otherwise(each("v_blocks")))
    q_block = F.explode(F.when(F.col("is_vector"), each("q_blocks")).otherwise(F.array(own("q_blocks"))))
    met = dealt.withColumn("v_block", v_block).withColumn("q_block", q_block).select("part", "v_block", "q_block", "is_vector", "vec_id", "v", "codes")
    place = ["part", "v_block", "q_block"]
    return met.repartition(*place).sortWithinPartitions(*place, "is_vector").mapInArrow(_rerank(k), FOUND)


def search(vectors: DataFrame, queries: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row that ``queries`` (on vec_id) chooses.

    Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids or
    vectors of another number of dimensions than most; a query's own id is no candidate; repeated rows count once; of a query with several vectors the least counts; ties go to
    the smaller id; each query gets k rows or, if there are fewer candidates, all of them; an empty table gives no rows; other
    columns are ignored. Of equal vectors, the k + 1 smallest ids alone can be among the nearest, so only these are indexed.
    """
    spark = vectors.sparkSession
    rows = sound(vectors, vector, key)
    rounds = fit(rows, k)
    if not rounds:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dimension = len(rounds[0].mean)
    rows = rows.where(F.size("v") == dimension)
    copies = Window.partitionBy("v").orderBy("vec_id")
    once = F.coalesce(F.lag("vec_id").over(copies) != F.col("vec_id"), F.lit(True))
    indexed = rows.select("*", F.dense_rank().over(copies).alias("copy"), once.alias("once")).where((F.col("copy") <= k + 1) & F.col("once")).select("vec_id", "v")
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = rows.count()
    out = None
    for hashing in rounds:
        found = _round(indexed, asked, spark.sparkContext.broadcast(hashing), k, n)
        # A query has met its neighbours if the k-th is within reach
        best = cut(_merged(found, k))
        met = best.where((F.col("rank") == k) & (F.col("score") <= REACH * hashing.width)).select("query_id")
        done = best.join(met, "query_id", "left_semi")
        out = done if out is None else out.union(done)
        asked = cut(asked.join(met.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti"))
    left = asked.count()
    blocks = -(-left * dimension * 8 // SCANNED)
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if some:
            shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in some], np.int64), np.array([r.v for r in some], np.float64)))
            out = out.union(cut(_merged(rows.mapInArrow(_scan(shared, k), FOUND), k)).select(out.columns))
            shared.unpersist()
    return out.select("query_id", "rank", "vec_id", "score")
