"""Incremental forms of batch operators under Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.operators.sequences import tile
from strandloom.session import scratch_path


def incremental_tiles(spark: SparkSession, source: str, schema: str, *, id_col: str, seq_col: str, window: int, stride: int, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """Windows of all files in ``source``; files that a checkpoint knows are not
    read again, so a second run tiles new files only (R01)."""
    sink, checkpoint = sink or scratch_path(spark, "tiles"), checkpoint or scratch_path(spark, "tiles-checkpoint")
    rows = spark.readStream.schema(schema).parquet(source)
    q = tile(rows, id_col=id_col, seq_col=seq_col, window=window, stride=stride).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink)


def _keep_best(drop: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, n, halted = state.get if state.exists else (None, 0, False)
        rounds = pd.concat(list(batches)).sort_values("round")
        before = rounds["recall"].cummax().shift(1)
        if best is not None:
            before = before.fillna(best).clip(lower=best)
        halted = bool(halted or (before - rounds["recall"] >= drop).any())
        top = int(rounds["recall"].max())
        best, n = top if best is None else max(best, top), n + len(rounds)
        state.update((best, n, halted))
        yield pd.DataFrame({"run": [key[0]], "best": [best], "rounds": [n], "halted": [halted]})

    return run


def best_so_far(spark: SparkSession, source: str, schema: str, *, drop: int, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """``run, best, rounds, halted`` after all rounds in ``source``; the best is a value
    state, so a later round updates it (R02), and a run halts once a round's recall
    lies ``drop`` or more below the best of the rounds before it. Rounds that arrive
    together are taken in order. The sink keeps every update and the last per run is
    returned."""
    sink, checkpoint = sink or scratch_path(spark, "monitor"), checkpoint or scratch_path(spark, "monitor-checkpoint")
    rows = spark.readStream.schema(schema).parquet(source)
    out = rows.groupBy("run").applyInPandasWithState(_keep_best(drop), "run long, best long, rounds long, halted boolean", "best long, n long, halted boolean", "append", GroupStateTimeout.NoTimeout)
    q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink).groupBy("run").agg(F.max("best").alias("best"), F.max("rounds").alias("rounds"), F.bool_or("halted").alias("halted"))
