"""Changes to files as a stream, and the ledger's totals as they grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import extract, incremental
from ..operators.graph import Graph
from ..operators.views import members
from ..schema import USAGE
from ..sources.tree import ignored

CHANGE = "path string, text string, change string, seq bigint"
#: The same, with the time of the event.
EVENT = f"{CHANGE}, at timestamp"


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change events (path, text, change, seq), one JSON line each: change is added, modified or deleted."""
    return spark.readStream.schema(CHANGE).json(folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Change events with their times (path, text, change, seq, at), one JSON line each."""
    return spark.readStream.schema(EVENT).json(folder)


def settled(stream: DataFrame, quiet: str = "500 milliseconds", late: str = "1 second") -> DataFrame:
    """(path, text, change, seq, events): the last event of each burst, once its path has been quiet for so long.

    Bursts are session windows by path, so each event puts its burst's end off again and events that come twice change nothing.
    Ignored paths are dropped before any state is kept; events later than ``late`` behind the newest are lost. A burst is given
    when the watermark has passed its end.
    """
    rows = stream.where(F.col("path").isNotNull() & ~ignored(F.col("path"))).withWatermark("at", late)
    last = F.max_by(F.struct("text", "change", "seq"), "seq")
    bursts = rows.groupBy(F.session_window("at", quiet), "path").agg(last.alias("last"), F.count("*").alias("events"))
    return bursts.select("path", "last.text", "last.change", "last.seq", "events")


def affected(graph: Graph, batch: DataFrame) -> DataFrame:
    """(path, feature): the features that anything in a changed file (path) belongs to."""
    here = graph.active().join(batch.select("path").distinct(), "path").select("urn", "path")
    return here.join(members(graph), "urn").select("path", "feature").distinct()


def latest(batch: DataFrame) -> DataFrame:
    """The last event of each path."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))
    return batch.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def apply(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Nodes (urn, kind, path, status, created_at) after the files of a batch were read again; those of other files stay."""
    last = latest(batch)
    touched = last.select("path")
    at = F.current_timestamp()
    found = extract.symbols(last.where("change != 'deleted'")).select("urn", F.lit("symbol").alias("kind"), "path", F.lit("active").alias("status"), at.alias("created_at")).dropDuplicates(["urn"])
    before = nodes.join(touched, "path", "left_semi")
    merged = incremental.reconcile(before, found, kept_kinds=("feature",)).drop("action")
    paths = before.select("urn", "path").union(found.select("urn", "path")).dropDuplicates(["urn"])
    return nodes.join(touched, "path", "left_anti").select("urn", "kind", "path", "status", "created_at").union(merged.join(paths, "urn").select("urn", "kind", "path", "status", "created_at"))


def watch(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "500 milliseconds") -> StreamingQuery:
    """Brings nodes up to date with each batch of changes: what ``read`` gives, after the batch, goes to ``write`` with the batch's number.

    A batch may come again after a failure; with the same number ``write`` should replace what it wrote. With ``every`` null the
    stream takes what is there and ends.
    """

    def run(batch: DataFrame, number: int) -> None:
        write(apply(read(), batch), number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def usage_by_day(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """(day, command, n, tokens) of a growing ledger; a day is final once records are later than it by ``late``."""
    rows = spark.readStream.schema(USAGE).json(folder).withWatermark("timestamp", late)
    out = rows.groupBy(F.window("timestamp", "1 day"), "command").agg(F.count("*").alias("n"), F.sum("tokens_generated").alias("tokens"))
    return out.select(F.col("window.start").alias("day"), "command", "n", "tokens")
