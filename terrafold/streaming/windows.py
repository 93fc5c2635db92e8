"""Scene streams: windowed statistics, late arrivals, and sequences kept in state."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scene_stream(spark: SparkSession, sf_dir: str, *, files_per_trigger: int = 1) -> DataFrame:
    """The scenes table as a stream of its files, with ts and arrival_ts as timestamps."""
    path = f"{sf_dir}/scenes.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    s = r.parquet(path) if os.path.isdir(path) else r.option("pathGlobFilter", "scenes.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrival_ts", F.col("arrival_ts").cast("timestamp"))


def window_stats(stream: DataFrame, by: list[str], *, size: str = "1 day", late: str = "30 days", slide: str | None = None) -> DataFrame:
    """Count and mean of a value per window of event time; a window closes ``late`` after its end."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = stream.where("ts IS NOT NULL").withWatermark("ts", late).groupBy(w.alias("w"), *by)
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def without_repeats(stream: DataFrame, keys: list[str], *, late: str = "30 days") -> DataFrame:
    """Each scene once, as long as its copies arrive within ``late`` of it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def slot_sequences(steps: DataFrame, by: str, *, slots: int, strides: int | None = None) -> DataFrame:
    """(by, sample, values) of ``slots`` consecutive steps, emitted when the last one arrives.

    Steps of a series must arrive in order, as closed windows do. The state of a series is the steps of its open sequences.
    """
    stride = strides or slots

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, seen = state.get if state.exists else ([], 0)
        kept = list(kept)
        out = []
        for pdf in batches:
            for v in pdf.sort_values("start")["mean"]:
                kept.append(None if pd.isna(v) else float(v))
                seen += 1
                if seen >= slots and (seen - slots) % stride == 0:
                    out.append((key[0], (seen - slots) // stride, kept[-slots:]))
                kept = kept[-slots:]
        state.update((kept, seen))
        if out:
            yield pd.DataFrame(out, columns=[by, "sample", "values"])

    return steps.groupBy(by).applyInPandasWithState(advance, f"{by} string, sample long, values array<double>", "kept array<double>, seen long", "append", GroupStateTimeout.NoTimeout)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    from terrafold.session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_to_end(result: DataFrame, *, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result, written to the shared folder.

    In complete mode each batch replaces the last; in append mode batches are kept side by side, a repeated batch
    overwrites itself.
    """
    spark = result.sparkSession
    folder = shared_folder(spark)

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch}")

    q = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
