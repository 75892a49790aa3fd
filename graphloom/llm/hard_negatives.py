"""Hard negatives by rotated one-bit codes.

Vectors become whole numbers. Each one's residual from a centre is rotated and kept as signs, one bit a dimension, with the
residual's inner product with its unit code vector (the alignment); what the code leaves over is coded again, ``LEVELS`` times,
and the length of the last rest is kept. An anchor's inner product with a code is a weighted popcount over the bit planes of the
rotated, quantised anchor. The rest is orthogonal to the last code vector, so by Cauchy and Schwarz the true score lies within

    estimate +- (sum of alignments * quantisation error + length of the rest * length of the anchor's part off that code vector)

which no draw of the rotation can break. Only candidates whose interval reaches what is still wanted are scored, in whole numbers.

Anchors and rows meet in a grid: rows are dealt into blocks (of one group of labels for the positives, of all for the negatives),
anchors into others, and each pair of blocks is a task's group that streams its rows past its anchors. A task keeps the best few
of each anchor alone; these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held, stored

LEVELS, PLANES, SEED = 4, 7, 11
#: Vectors that the centre and the number of dimensions are taken from; the intervals hold for any centre.
SAMPLE = 2000
#: Rows and anchors of a block at most, rows of a block at least, and groups of labels at least.
BLOCK, ASKED, LEAST, GROUPS = 1 << 20, 1 << 15, 1 << 10, 64
#: Rows and anchors whose estimates are held at once.
STRIP, CHUNK = 4096, 64
#: Integer vectors longer than the square root of this take no part: their scores needn't fit 64 bits.
LONGEST = 2.0**62
#: Rounding of the estimate: alignments are kept as floats.
SLACK = 4e-6
INDEX = "vec_id bigint, label bigint, y array<int>, codes array<bigint>, aligned array<float>, rest double"
FOUND = "anchor_id bigint, positive_id bigint, vec_id bigint, score bigint"


@dataclass
class Coder:
    scale: float
    centre: np.ndarray
    rotation: np.ndarray  # orthogonal, dimensions x dimensions

    @property
    def words(self) -> int:
        return -(-len(self.centre) // 64)

    def bits(self, on: np.ndarray) -> np.ndarray:
        """The last axis of booleans as 64-bit words."""
        padded = np.zeros((*on.shape[:-1], self.words * 64), np.uint8)
        padded[..., : on.shape[-1]] = on
        return np.packbits(padded, axis=-1).view(np.uint64)

    def code(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (rows x levels x words), alignments (rows x levels) and the lengths of the rests."""
        z = (y - self.centre) @ self.rotation
        root, codes, aligned = np.sqrt(len(self.centre)), [], []
        for _ in range(LEVELS):
            up = z >= 0
            a = np.abs(z).sum(axis=1) / root
            z = z - np.where(up, 1.0, -1.0) * (a / root)[:, None]
            codes.append(self.bits(up))
            aligned.append(a)
        return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.sqrt((z**2).sum(axis=1))


class Anchors:
    """Some anchors with the windows of scores that each wants filled by its k best."""

    def __init__(self, coder: Coder, ids: np.ndarray, labels: np.ndarray, y: np.ndarray, wanted: list[list[tuple[int, int, int]]], same: bool, k: int):
        self.coder, self.ids, self.labels, self.y, self.same, self.k = coder, ids, labels, y, same, k
        x = y.astype(np.float64)
        z = x @ coder.rotation
        low = z.min(axis=1)
        step = (z.max(axis=1) - low) / (2**PLANES - 1)
        step[step == 0] = 1.0
        q = np.rint((z - low[:, None]) / step[:, None]).astype(np.int64)
        near = low[:, None] + step[:, None] * q
        self.low, self.step, self.total = low, step, near.sum(axis=1)
        self.off = np.abs(z - near).sum(axis=1) / np.sqrt(z.shape[1])
        self.planes = coder.bits((q[:, None, :] >> np.arange(PLANES)[None, :, None]) & 1 == 1)  # anchors x planes x words
        self.base, self.length = x @ coder.centre, np.sqrt((x**2).sum(axis=1))
        # positive_id, least and greatest score of each window
        self.wanted = wanted
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(w) for w in wanted]
        self.need = [[low for _, low, _ in w] for w in wanted]
        self.least = np.array([min((low for _, low, _ in w), default=2**62) for w in wanted], np.float64)
        self.most = np.array([max((high for _, _, high in w), default=-(2**62)) for w in wanted], np.float64)

    def intervals(self, part: slice, codes: np.ndarray, ones: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the scores, and how far off each can be: anchors x rows."""
        root = np.sqrt(len(self.coder.centre))
        estimate, inner = np.repeat(self.base[part][:, None], len(codes), axis=1), None
        for level in range(LEVELS):
            counts = np.zeros((len(estimate), len(codes)), np.int32)
            for plane in reversed(range(PLANES)):
                counts <<= 1
                for w in range(self.coder.words):
                    counts += np.bitwise_count(self.planes[part, plane, w][:, None] & codes[None, :, level, w])
            inner = counts * (2 * self.step[part] / root)[:, None]
            inner += (2 * self.low[part] / root)[:, None] * ones[None, :, level] - (self.total[part] / root)[:, None]
            estimate += inner * aligned[None, :, level]
        length, off = self.length[part][:, None], self.off[part][:, None]
        along = np.maximum(np.abs(inner) - off, 0)
        across = np.sqrt(np.maximum(length**2 - along**2, 0))
        sums = aligned.sum(axis=1)
        size = sums + rest + np.sqrt((self.coder.centre**2).sum())
        return estimate, off * sums[None] + rest[None] * across + SLACK * size[None] * length + SLACK

    def meet(self, ids: np.ndarray, labels: np.ndarray, y: np.ndarray, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> None:
        ones = np.bitwise_count(codes).sum(axis=2, dtype=np.int64).astype(np.float64)
        size = np.sqrt((y.astype(np.float64) ** 2).sum(axis=1).max()) if len(y) else 0.0
        for first in range(0, len(self.ids), CHUNK):
            part = slice(first, min(first + CHUNK, len(self.ids)))
            estimate, off = self.intervals(part, codes, ones, aligned, rest)
            maybe = (estimate + off >= self.least[part][:, None]) & (estimate - off <= self.most[part][:, None])
            maybe &= ((labels[None] == self.labels[part][:, None]) == self.same) & (ids[None] != self.ids[part][:, None])
            for i in np.flatnonzero(maybe.any(axis=1)):
                mine = np.flatnonzero(maybe[i])
                a = self.y[first + i]
                if size * self.length[first + i] < 2.0**53:  # every partial sum is a whole number that a double holds
                    score = (y[mine].astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
                else:
                    score = y[mine].astype(np.int64) @ a.astype(np.int64)
                self._keep(first + i, ids[mine], score)

    def _keep(self, n: int, ids: np.ndarray, score: np.ndarray) -> None:
        for j, (_, low, high) in enumerate(self.wanted[n]):
            good = (score >= self.need[n][j]) & (score <= high)
            if not good.any():
                continue
            s, i = (np.concatenate(x) for x in zip(self.held[n][j], (score[good], ids[good]), strict=True))
            order = np.lexsort((i, -s))
            s, i = s[order], i[order]
            new = np.r_[True, (np.diff(s) != 0) | (np.diff(i) != 0)]
            self.held[n][j] = (s[new][: self.k], i[new][: self.k])
            if new.sum() >= self.k:
                self.need[n][j] = int(self.held[n][j][0][-1])
        self.least[n] = min(self.need[n])

    def rows(self) -> Iterator[pa.RecordBatch]:
        out = [(a, p, i, s) for a, wanted, kept in zip(self.ids.tolist(), self.wanted, self.held, strict=True) for (p, _, _), (ss, ii) in zip(wanted, kept, strict=True) for s, i in zip(ss.tolist(), ii.tolist(), strict=True)]
        for at in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + (1 << 16)], strict=True)], names=["anchor_id", "positive_id", "vec_id", "score"])


def sound(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, in double precision."""
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))


def fit(rows: DataFrame, scale: float) -> Coder | None:
    """Centre and dimensions from at most SAMPLE vectors, those of the smallest id hashes; the rotation is drawn. None without rows."""
    got = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    if not got:
        return None
    dimension = max(sorted({len(v) for v in got}), key=lambda d: sum(len(v) == d for v in got))
    with np.errstate(over="ignore"):
        y = np.floor(np.array([v for v in got if len(v) == dimension], np.float64) * scale)
        y = y[(y**2).sum(axis=1) < LONGEST]
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dimension, dimension)))
    return Coder(scale, np.median(y, axis=0) if len(y) else np.zeros(dimension), q * np.sign(np.diag(r)))


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1), kind))


def index(rows: DataFrame, coder: Coder) -> DataFrame:
    """Each row's integer vector with its codes, alignments and rest."""
    shared = rows.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for whole in batches:
            for at in range(0, len(whole), STRIP):
                b = whole.slice(at, STRIP)
                with np.errstate(over="ignore"):
                    y = np.floor(_flat(b.column(2), np.float64) * coder.scale)
                    fits = (y**2).sum(axis=1) < LONGEST
                b, y = b.filter(pa.array(fits)), y[fits]
                codes, aligned, rest = coder.code(y)
                lists = [_lists(y.astype(np.int32), pa.int32()), _lists(codes.reshape(len(y), LEVELS * coder.words).view(np.int64), pa.int64()), _lists(aligned.astype(np.float32), pa.float32())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, pa.array(rest)], names=["vec_id", "label", "y", "codes", "aligned", "rest"])

    return rows.where(F.size("v") == len(coder.centre)).mapInArrow(run, INDEX)


def _search(shared, k: int, same: bool):
    """For ``mapInArrow``: rows by block, anchors before vectors; the best of each block's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked, anchors = None, [], None
        coder = shared.value
        for whole in batches:
            place = np.stack([whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            runs = np.flatnonzero(np.r_[True, (np.diff(place, axis=0) != 0).any(axis=1)])
            for begin, end in zip(runs, [*runs[1:], len(whole)], strict=True):
                block, is_row = tuple(place[begin, :3]), place[begin, 3]
                if block != here:
                    if anchors:
                        yield from anchors.rows()
                    here, asked, anchors = block, [], None
                if not is_row:
                    asked.append(whole.slice(begin, end - begin))
                    continue
                if not asked and not anchors:
                    continue
                if not anchors:
                    b = pa.Table.from_batches(asked).combine_chunks()
                    ids, labels, y, windows = (b.column(i).combine_chunks() for i in (4, 5, 6, 10))
                    wanted = [[(w["id"], w["low"], w["high"]) for w in ws] for ws in windows.to_pylist()]
                    anchors, asked = Anchors(coder, ids.to_numpy(), labels.to_numpy(), _flat(y, np.int32), wanted, same, k), []
                for at in range(begin, end, STRIP):
                    b = whole.slice(at, min(STRIP, end - at))
                    codes = _flat(b.column(7), np.int64).view(np.uint64).reshape(len(b), LEVELS, coder.words)
                    anchors.meet(b.column(4).to_numpy(), b.column(5).to_numpy(), _flat(b.column(6), np.int32), codes, _flat(b.column(8), np.float64), b.column(9).to_numpy())
        if anchors:
            yield from anchors.rows()

    return run


def _met(indexed: DataFrame, anchors: DataFrame, shared, k: int, same: bool, block: int, rows: int, asked: int) -> DataFrame:
    """The best rows of each anchor's windows, from every pair of blocks: of the anchor's label, or of other labels."""
    own = lambda of: F.pmod(F.xxhash64("vec_id"), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    parts = lambda n, of: F.greatest(F.ceil(n / of), F.lit(1)).cast("int")
    codes = ["vec_id", "label", "y", "codes", "aligned", "rest"]
    nothing = F.lit(None).cast("array<struct<id:bigint,low:bigint,high:bigint>>")
    left = indexed.select(*codes, nothing.alias("windows"), F.lit(True).alias("is_row"))
    right = anchors.select(*codes, "windows", F.lit(False).alias("is_row"))
    if same:
        groups = max(GROUPS, -(-rows // block))
        both = left.union(right).withColumn("place", F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int"))
        sizes = both.groupBy("place").agg(parts(F.count_if("is_row"), block).alias("r"), parts(F.count_if(~F.col("is_row")), ASKED).alias("a"))
        both = both.join(held(sizes, groups), "place")
    else:
        both = left.union(right).withColumns({"place": F.lit(0), "r": F.lit(max(1, -(-rows // block))), "a": F.lit(max(1, -(-asked // ASKED)))})
    # A row has its row block and goes to every anchor block; an anchor the other way round
    both = both.withColumn("r_block", F.explode(F.when(F.col("is_row"), F.array(own(F.col("r")))).otherwise(F.sequence(F.lit(0), F.col("r") - 1))))
    both = both.withColumn("a_block", F.explode(F.when(F.col("is_row"), F.sequence(F.lit(0), F.col("a") - 1)).otherwise(F.array(own(F.col("a"))))))
    at = ["place", "r_block", "a_block"]
    return both.select(*at, "is_row", *codes, "windows").repartition(*at).sortWithinPartitions(*at, "is_row").mapInArrow(_search(shared, k, same), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor's window, by score, then id; repeated rows count once."""
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for the rows that ``anchors`` (on vec_id) chooses.

    A vector's components are floor(scale * x); a score is the inner product of two such. An anchor's positives are its first
    rows of the same label by score, then id; a positive's negatives the first rows of other labels whose score is from ``low``
    to ``high`` per cent of the positive's. Results are exact: the intervals only save scoring.

    Defined results: rows with a null id or label, a vector that is null, empty, of another number of dimensions than most, or
    with null or non-finite components take no part, nor do integer vectors of a squared length of 2^62 or more, whose scores
    needn't fit 64 bits; zero vectors do. Rows that repeat an id count once for each score, and an id is no candidate of its own;
    of an anchor with several rows the least (label, then vector) counts. A negative score of a positive has no negatives, as
    its range is empty. An empty table, or one without anchors, gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = sound(vectors, vector, key, label)
    coder = fit(rows, scale)
    if coder is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    indexed = stored(index(rows, coder))
    shared = spark.sparkContext.broadcast(coder)
    codes = ["label", "y", "codes", "aligned", "rest"]
    chosen = cut(indexed.where(anchors).groupBy("vec_id").agg(F.min(F.struct(*codes)).alias("least")).select("vec_id", "least.*"))
    n, asked = indexed.count(), chosen.count()
    block = min(BLOCK, max(LEAST, n // (4 * spark.sparkContext.defaultParallelism)))
    window = lambda id, low, high: F.struct(id.cast("bigint").alias("id"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
    anywhere = chosen.withColumn("windows", F.array(window(F.lit(0), F.lit(-(2**62)), F.lit(2**62))))
    near = cut(_best(_met(indexed, anywhere, shared, positives, True, block, n, asked), positives).select("anchor_id", F.col("vec_id").alias("id"), "score"))
    # Per cent of a score in whole numbers that don't overflow: of its hundreds, and of what is left
    left = F.pmod(F.col("score"), F.lit(100))
    hundreds = F.expr("(score - pmod(score, 100)) div 100")
    windows = near.select("anchor_id", window(F.col("id"), hundreds * low + F.ceil(left * low / 100), hundreds * high + F.floor(left * high / 100)).alias("w")).where("w.low <= w.high")
    wanting = chosen.join(windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list("w")).alias("windows")), "vec_id")
    found = _best(_met(indexed, wanting, shared, negatives, False, block, n, asked), negatives)
    scores = near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(scores, ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
