"""The array's reductions over unbounded streams of values, with event time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.cut import checkpoint_folder


#: Rows that a key puts out at a time.
PIECE = 100_000


def _reduced(windows: DataFrame, value: Column, keys: tuple[str, ...]) -> DataFrame:
    return (
        windows.agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "sum", "min", "max", "mean", "stdev")
    )


def windowed(stream: DataFrame, ts: str, value: Column, width: str, *keys: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum, extremes, mean and deviation of values in tumbling or sliding windows of event time.

    State is bounded by the windows that the watermark still keeps open.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _reduced(stream.withWatermark(ts, late).groupBy(window.alias("window"), *keys), value, keys)


def sessions(stream: DataFrame, ts: str, value: Column, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """The same of each key's values that follow one another with no longer pause than ``gap``.

    A stream's sessions need a key.
    """
    return _reduced(stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys), value, keys)


def totals(stream: DataFrame, value: Column, key: str) -> DataFrame:
    """``key, n, sum``: of each key that a batch brings values of, the count and sum over the whole stream.

    The cumulative sum of a stream that never ends. State is one row a key; a batch's rows of a key are
    read in pieces, so a key may have any number of them. A null value adds nothing; a null key is a key.
    """

    def add(own: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for piece in pieces:
            n, total = n + int(piece["_total"].count()), total + float(piece["_total"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [own[0]], "n": [n], "sum": [total]})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, value.cast("double").alias("_total"))
    return rows.groupBy(key).applyInPandasWithState(add, f"`{key}` {kind}, n bigint, sum double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def cumulative(stream: DataFrame, ts: str, value: Column, key: str, late: str = "10 minutes") -> DataFrame:
    """``key, ts, value, n, sum, diff, largest, largest_at``: running figures of each key's values in event time.

    n and sum go up to and with the row, ``diff`` is what the value adds to the one before it, ``largest``
    the greatest value so far, the first of equals, and ``largest_at`` its time. Rows wait in the state
    until the watermark, ``late`` behind the newest event, has passed them, and leave it in order of time,
    then value, so rows that come out of order within that delay count where they belong; rows that
    come later still are dropped. An event-time timer lets a key's last rows go when nothing more of the key
    comes. State is a key's waiting rows, 16 bytes each, and five numbers; rows leave in pieces. Null times are dropped, null values too.
    """

    def run(own: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, n, total, last, largest, at = state.get if state.exists else (b"", b"", 0, 0.0, None, None, None)
        times, values = [np.frombuffer(times, np.int64)], [np.frombuffer(values, np.float64)]
        for piece in pieces:
            if len(piece):
                times.append(piece["_ts"].to_numpy("datetime64[us]").astype(np.int64))
                values.append(piece["_v"].to_numpy(np.float64))
        times, values = np.concatenate(times), np.concatenate(values)
        order = np.lexsort((values, times))
        times, values = times[order], values[order]
        ready = int(np.searchsorted(times, state.getCurrentWatermarkMs() * 1000, "right"))
        for low in range(0, ready, PIECE):
            t, v = times[low : min(low + PIECE, ready)], values[low : min(low + PIECE, ready)]
            sums = np.cumsum(np.concatenate([[total], v]))[1:]
            steps = np.diff(v, prepend=np.nan if last is None else last)
            most = np.maximum.accumulate(v if largest is None else np.maximum(v, largest))
            fresh = v > np.concatenate([[-np.inf if largest is None else largest], most[:-1]])
            if largest is None:
                fresh[0] = True
            since = np.maximum.accumulate(np.where(fresh, np.arange(len(v)), -1))
            places = np.where(since >= 0, t[since], 0 if at is None else at)
            diff = pd.Series(steps).astype(object).where(np.arange(len(v)) > 0, None) if last is None else steps
            yield pd.DataFrame({key: [own[0]] * len(v), ts: t.astype("datetime64[us]"), "value": v, "n": n + 1 + np.arange(len(v)), "sum": sums, "diff": diff, "largest": most, "largest_at": places.astype("datetime64[us]")})
            n, total, last, largest, at = n + len(v), float(sums[-1]), float(v[-1]), float(most[-1]), int(places[-1])
        times, values = times[ready:], values[ready:]
        state.update((times.tobytes(), values.tobytes(), n, total, last, largest, at))
        if len(times):
            state.setTimeoutTimestamp(int(times[0]) // 1000 + 1)

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(ts).cast("timestamp").alias("_ts"), value.cast("double").alias("_v")).dropna(subset=["_ts", "_v"]).withWatermark("_ts", late)
    schema = f"`{key}` {kind}, `{ts}` timestamp, value double, n bigint, sum double, diff double, largest double, largest_at timestamp"
    held = "times binary, values binary, n bigint, total double, last double, largest double, at bigint"
    return rows.groupBy(key).applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def appended(stream: DataFrame, name: str) -> DataFrame:
    """All rows that a stream has put out once the input that is there now is read, as a table."""
    spark = stream.sparkSession
    place = f"{checkpoint_folder(spark)}/arraymill/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/log").option("path", f"{place}/rows")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def settled(stream: DataFrame, name: str) -> DataFrame:
    """The rows that an aggregated stream has once all input that is there now is read, as a table."""
    spark = stream.sparkSession
    place = f"{checkpoint_folder(spark)}/arraymill/{name}-{uuid.uuid4().hex}"
    rows = f"{place}/rows"
    spark.createDataFrame([], stream.schema).write.parquet(rows)
    run = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/log").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows))
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows)
