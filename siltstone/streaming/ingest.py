"""Live ingest: directories to tables in small batches, with aggregates kept beside the events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.changefeed import ChangeStore
from siltstone.operators.sessions import SessionStore


def watch(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; a batch takes so many at most."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_batch).load(path)


def append(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """The stream's rows appended to a table of Parquet files, exactly once; runs until the present input is read."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (w.partitionBy(*partition_by) if partition_by else w).start()


def each_batch(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, store: SessionStore, checkpoint: str, user: str, ts: str, event_id: str) -> StreamingQuery:
    """Sessions kept up to date; a batch that is repeated after a failure changes nothing, since its ids are known."""
    return each_batch(stream, checkpoint, lambda batch, _: store.apply(batch, user, ts, event_id))


def changes(stream: DataFrame, store: ChangeStore, checkpoint: str, entry: str, seq: str, adds: str, removes: str, flag: str) -> StreamingQuery:
    """A change feed applied as it arrives; repeated batches hold changes that are known."""
    return each_batch(stream, checkpoint, lambda batch, _: store.apply(batch, entry, seq, adds, removes, flag))


def daily_counts(stream: DataFrame, at: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Counts per day and ``by`` of a stream, each final once the watermark has passed the day: state is bounded by it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day"), *by).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyyMMdd").alias("day"), *by, "n")
