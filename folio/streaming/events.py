"""Token events to answers, telemetry in windows, and incremental ingestion.

The answer rules also hold for batches; event-time windows are an addition of this engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.sources.files import todo


def answers(events: DataFrame, query: str = "query_id") -> DataFrame:
    """Per query the tokens after its last reset, joined in order; the time of the first of them; whether it is done or failed."""
    last = F.max(F.when(F.col("event") == "reset", F.col("seq"))).over(Window.partitionBy(query))
    live = events.withColumn("_reset", F.coalesce(last, F.lit(-1)))
    token = (F.col("event") == "token") & (F.col("seq") > F.col("_reset"))
    pieces = F.array_sort(F.collect_list(F.when(token, F.struct("seq", "payload"))))
    return live.groupBy(query).agg(
        F.array_join(F.transform(pieces, lambda p: p["payload"]), "").alias("answer"), F.min(F.when(token, F.col("ts"))).alias("first_token_ts"),
        F.count_if(F.col("event") == "reset").alias("resets"), F.max(F.col("event") == "done").alias("done"), F.max(F.col("event") == "error").alias("failed"),
    )


def windowed(events: DataFrame, by: str, size: str, slide: str | None = None, late: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Count, mean and maximum by event-time window; with `late` a watermark drops what comes later than that."""
    source = events.withWatermark(ts, late) if late else events
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = source.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("largest"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "mean", "largest")


def sessions(events: DataFrame, by: str, gap: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    """Runs of events without a pause of `gap`."""
    source = events.withWatermark(ts, late) if late else events
    return source.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def incremental(source: DataFrame, process: Callable[[DataFrame], DataFrame], done: Callable[[], DataFrame], sink: Callable[[DataFrame], None], key: str, checkpoint: str) -> StreamingQuery:
    """Processes what is new in a stream once: rows whose key the sink holds already are left out of each batch, so a repeated batch changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        fresh = todo(rows.dropDuplicates([key]), done(), key)
        if not fresh.isEmpty():
            sink(process(fresh))

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
