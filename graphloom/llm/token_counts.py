"""Token counts by a two-tier lookup on the map side.

The frequent pre-tokens are those of a bounded sample: at most ``SAMPLE`` documents, those of the least hashes of their ids as far
as a bound taken from their number reaches. One task counts them, and the ``FREQUENT`` commonest, with their lengths in tokens, are
broadcast. The counting pass looks pre-tokens up there, then in its worker's cache, which stays from task to task, then in the
library. No pre-token is shuffled. The table decides speed alone, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .tokens import Frequent, frequent_pieces, piece_counts, tokenizer_path

SAMPLE, FREQUENT, LIMIT = 2000, 16384, 4096


def frequent_lengths(docs: DataFrame, path: str) -> Frequent:
    """At most ``FREQUENT`` pre-tokens of at most 48 characters: the broadcast is below 2 MB whatever the input."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = frequent_pieces((b.column(0) for b in batches), FREQUENT)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(found.keys(), pa.string())})

    one_in = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(one_in)) == 0).limit(SAMPLE)
    pieces = [r.piece for r in sample.select(F.col("text").cast("string")).mapInArrow(tidy(local), "piece string").collect()]
    return Frequent(dict(zip(pieces, piece_counts(path).lengths(pa.array(pieces, pa.string())).tolist(), strict=True)))


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, as the library counts the whole text without added tokens.

    Defined results: a null text counts as empty, with 0 tokens; a null doc_id and repeated rows give a row each; an empty
    table gives no rows; other columns are ignored.
    """
    path = tokenizer_path(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts.counts(b.column(1), shared.value), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    return rows.mapInArrow(tidy(count), "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
