"""Sums of arrays over all rows: each task adds up its own, then fewer tasks add those up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks of the second step: so many arrays reach the driver at most.
FAN_IN = 16


def task_sums(rows: DataFrame, made: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of rows of made(batch), an array of `size` numbers."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for p in parts:
            if len(p):
                total += made(p)
        yield pd.DataFrame({"v": [total]})

    def again(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for p in parts:
            for v in p["v"]:
                total += v
        yield pd.DataFrame({"v": [total]})

    sums = rows.mapInPandas(each, "v array<double>")
    if sums.rdd.getNumPartitions() > 2 * FAN_IN:
        sums = sums.repartition(FAN_IN, F.spark_partition_id()).mapInPandas(again, "v array<double>")
    return np.sum([r["v"] for r in sums.collect()], axis=0) + np.zeros(size)
