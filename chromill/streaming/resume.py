"""Incremental crawls as streams: what is new is processed once, whatever fails in between."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def process_new(spark: SparkSession, folder: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 100, retry_errors: bool = True) -> int:
    """Runs transform over the files of folder that no earlier run saw, in micro-batches, and appends Parquet to out; returns the rows of out.

    The checkpoint remembers finished files, and each micro-batch writes its own folder, so a batch that is
    retried replaces itself. With retry_errors, rows whose status is error are left to later().
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).count()


def later(results: DataFrame, key: str = "filename") -> DataFrame:
    """Keys whose every result so far is an error: what a later run should try again."""
    return results.groupBy(key).agg(F.count_if(F.col("status") == "ok").alias("ok")).where("ok = 0").select(key)


STATE = "backoff double, n long"


def backoff_stream(attempts: DataFrame, host: str = "host") -> DataFrame:
    """Per host and micro-batch the back-off after its attempts (host, at, status) so far; state is kept by host.

    Within a batch attempts are taken in order of at. 200 multiplies by 0.9, to 0.5 at least; 429 by 1.5, to 5 at most.
    """
    kind = attempts.schema[host].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else (1.0, 0)
        for status in pd.concat(list(frames)).sort_values("at", kind="stable")["status"]:
            value = max(value * 0.9, 0.5) if status == 200 else min(value * 1.5, 5.0) if status == 429 else value
            n += 1
        state.update((value, n))
        yield pd.DataFrame({host: [key[0]], "n_attempts": [n], "backoff": [value]})

    return attempts.groupBy(host).applyInPandasWithState(step, f"{host} {kind}, n_attempts long, backoff double", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_success(attempts: DataFrame, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Attempts and successes by event-time window; rows later than the watermark are left out."""
    return attempts.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(F.col("status") == 200).alias("n_ok")).select("window.start", "window.end", "n", "n_ok")
