"""The one step of the engine that makes sense on a stream: daily means as measurements arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite


def daily_means(events: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """keys, date, value: the mean of each day's finite values; a day is final once the watermark has passed it.

    Works on static tables as well; then all days are final.
    """
    df = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark("_ts", late)
    out = df.groupBy(*keys, F.window("_ts", "1 day")).agg(F.avg(finite(value)).alias("value"))
    return out.select(*keys, F.to_date("window.start").alias("date"), "value").where("value is not null")
