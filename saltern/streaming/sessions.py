"""Streaming adapters: event-time bars and running positions of a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(stream: DataFrame, ts: str, key: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close and count by key and window of event time; rows later than ``late`` are left out."""
    place = F.struct(ts, value)
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))  # event time has a zone
    w = stream.withWatermark(ts, late).groupBy(key, F.window(ts, size).alias("w"))
    out = w.agg(F.min_by(value, place).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, place).alias("close"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def positions(stream: DataFrame, key: str, quantity: str, price: str) -> DataFrame:
    """Running quantity and average cost by key, kept as state between batches."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, cost = state.get if state.exists else (0.0, 0.0)
        for rows in batches:
            for q, p in zip(rows[quantity], rows[price], strict=True):
                if q > 0:
                    held, cost = held + q, cost + q * p
                elif held > 0:
                    part = min(1.0, -q / held)
                    held, cost = held * (1 - part), cost * (1 - part)
        state.update((held, cost))
        yield pd.DataFrame([(k[0], held, cost / held if held > 0 else 0.0)], columns=["key", "held", "average_cost"])

    rows = stream.select(F.col(key).cast("string").alias("key"), quantity, price)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, held double, average_cost double", "held double, cost double", "update", GroupStateTimeout.NoTimeout)
