"""Structured Streaming adapters: the same verbs over unbounded input. These go beyond batch frames' own features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Agg
from ..functions.expr import Context
from ..operators.frame import Frame


def stream_files(spark: SparkSession, format: str, path: str, schema: T.StructType, max_files: int | None = None, **options) -> Frame:
    reader = spark.readStream.format(format).schema(schema).options(**options)
    return Frame((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path))


def deduplicate(frame: Frame, keys: list[str], time: str, delay: str) -> Frame:
    """The first row of each key, as long as its moment is within ``delay`` of the newest; state beyond that is dropped."""
    return Frame(frame.df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys))


def windowed(frame: Frame, time: str, size: str, *aggs: Agg, keys: tuple[str, ...] = (), slide: str | None = None, delay: str | None = None) -> Frame:
    """Aggregates by event-time window (tumbling, or sliding with ``slide``) and keys; batch or stream, with a watermark if ``delay`` is given."""
    return _timed(frame, F.window(time, size, slide) if slide else F.window(time, size), time, aggs, keys, delay)


def sessions(frame: Frame, time: str, gap: str, *aggs: Agg, keys: tuple[str, ...] = (), delay: str | None = None) -> Frame:
    """Aggregates by session: rows of a key that are less than ``gap`` apart."""
    return _timed(frame, F.session_window(time, gap), time, aggs, keys, delay)


def _timed(frame: Frame, window, time: str, aggs: tuple[Agg, ...], keys: tuple[str, ...], delay: str | None) -> Frame:
    df = frame.df.withWatermark(time, delay) if delay else frame.df
    ctx = Context(df)
    out = df.groupBy(window.alias("_w"), *keys).agg(*[a.resolve(ctx).alias(a.name) for a in aggs])
    return Frame(out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"]))


def start(frame: Frame, sink: Callable, checkpoint: str, mode: str = "append", once: bool = True, by_batch: bool = False):
    """Run a sink for each micro-batch. A batch that is replayed after a failure is written again: appending sinks get its rows at least once.

    ``by_batch``: ``sink`` makes a sink from the batch's number, with a place of its own (``lambda n: to_parquet(f"out/batch={n}")``). It overwrites that place, so that
    a replayed batch replaces what it wrote, and rows are there exactly once."""

    def each(df: DataFrame, epoch: int) -> None:
        sink(epoch)(df, "overwrite", ()) if by_batch else sink(df, "append", ())

    writer = frame.df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
