"""Continuous redaction: the batch plan over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pipeline import Config, redact, scan


def redacted(stream: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:  # noqa: B008
    """``redact`` on a stream; stateless, so late or replayed rows give what they gave."""
    return redact(stream, config, text)


def start(stream: DataFrame, path: str, checkpoint: str, config: Config = Config(), interval: str | None = "1 second"):  # noqa: B008
    """Write redacted rows as Parquet, exactly once; without an interval all that is there is read, and the query ends."""
    writer = redacted(stream, config).drop("spans").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def rates(stream: DataFrame, config: Config = Config(), ts: str = "ts", text: str = "text", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:  # noqa: B008
    """Detections by window of event time and label; rows later than ``late`` are left out."""
    found = scan(stream.withWatermark(ts, late), config, text).select(ts, F.explode("detections").alias("d"))
    return found.groupBy(F.window(ts, window), F.col("d.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
