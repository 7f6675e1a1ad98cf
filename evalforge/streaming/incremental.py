"""Streaming counterparts of associative summaries; an extension, since the work is batch by
nature. State is one row a group, whatever the number of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_errors(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, rmse, mae and bias by keys, kept up to date as predictions arrive."""
    e = F.col("y_pred") - F.col("y_true")
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def windowed_coverage(pred: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Applicability-domain coverage in tumbling windows; rows later than the watermark are
    dropped with their state."""
    inside = F.count_if(F.coalesce("in_domain", F.lit(False)))
    g = pred.withWatermark(time, late).groupBy(F.window(time, length), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), inside.alias("n_in")).withColumn("coverage", F.col("n_in") / F.col("n"))
