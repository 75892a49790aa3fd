"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For ``bytes.translate``: A-Z become lower case; every byte that is no digit, letter or part of a longer UTF-8 sequence becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8: runs of digits, ASCII letters (lower-cased) and all non-ASCII characters."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """A column name for each of ``names`` that none of ``taken`` has, whatever their case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# Suffixes of two labels under which names are registered. Other suffixes are the last label.
SECOND_LEVEL = (
    "ac.at co.at or.at com.au edu.au gov.au net.au org.au com.br gov.br net.br org.br co.cr com.cn edu.cn gov.cn net.cn org.cn com.co com.eg com.es gob.es com.gr com.hk edu.hk "
    "co.hu co.id ac.il co.il org.il ac.in co.in gov.in net.in org.in ac.ir co.ir ac.jp co.jp go.jp ne.jp or.jp co.ke ac.kr co.kr go.kr or.kr com.mx gob.mx com.my com.ng ac.nz co.nz "
    "govt.nz net.nz org.nz com.pe com.ph com.pk com.pl edu.pl net.pl org.pl com.pt com.sa com.sg edu.sg co.th in.th com.tr edu.tr gov.tr org.tr com.tw edu.tw org.tw com.ua "
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk com.uy com.ve com.vn ac.za co.za gov.za org.za"
).split()


def host_name(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", "")


def host_parts(name: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host's name: the suffix is the longest known one, the domain has one label more."""
    second = F.substring_index(name, ".", -2)
    two = second.isin(SECOND_LEVEL)
    return F.when(two, F.substring_index(name, ".", -3)).otherwise(second), F.when(two, second).otherwise(F.substring_index(name, ".", -1))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null for a null one."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def give_back() -> None:
    """A worker lives on after its task; what it has freed goes back to the system now, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``run``, with memory given back after each input batch and at the end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            give_back()

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(each(batches))
        give_back()

    return tidied


def by_series(f: Callable[[str | None], object]) -> Callable[[pd.Series], pd.Series]:
    """For ``pandas_udf``: ``f`` of each text, whose nulls are None."""

    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([f(t) for t in texts], dtype=object)
        give_back()
        return out

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where that is unset, a temporary one, if all run on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder: a lost executor costs a read, not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder: for a table of many rows, or one that Python makes."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where a table of known size is narrow.
TASK_ROWS = 50_000


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in no more partitions than about so many rows need, or the cluster has cores: a small table stays in few files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS))


def held(df: DataFrame, rows: int) -> DataFrame:
    """The checkpointed rows, marked for a broadcast if there are so many at most; else joined as Spark sees fit."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of a batch between Spark and Python. Spark's own default is meant for narrower rows than documents.
#: FEW_ROWS: where a worker holds caches beside its batch.
BATCH_ROWS, FEW_ROWS, BATCH_SETTING = "1000", "250", "spark.sql.execution.arrow.maxRecordsPerBatch"


def for_documents(spark: SparkSession, rows: str = BATCH_ROWS) -> None:
    """For an application, before its queries: batches to Python become smaller, unless the session sets their size itself."""
    if spark.conf.get(BATCH_SETTING) in ("10000", BATCH_ROWS, FEW_ROWS):
        spark.conf.set(BATCH_SETTING, rows)
