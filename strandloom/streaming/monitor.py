"""Probe recall of mining rounds, watched as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandloom.session import scratch_path

#: A drop of exactly the threshold counts although shares are rounded.
TOLERANCE = 1e-9
DECISIONS = "run long, round long, hits long, probes long, best_prior double, best_round long, decision string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def round_outcomes(rounds: DataFrame, *, drop: float, minimum: int) -> DataFrame:
    """``DECISIONS`` of a whole table of ``run, round, hits, probes`` (W12), rounds
    numbered from 1; of rows that repeat a round the one of fewest hits counts, and
    rounds behind a gap wait.

    A round of fewer than ``minimum`` probes is ``inadmissible`` and no measure for
    others. One whose recall lies ``drop`` or more below the best before it is
    ``halt_rollback``, to the round of that best (the earliest); what comes after a
    halt is ``after_halt``; any other is ``continue``.
    """
    own = rounds.groupBy("run", "round").agg(F.min(F.struct("hits", "probes")).alias("r")).select("run", "round", "r.*")
    order = Window.partitionBy("run").orderBy("round")
    own = own.withColumn("_k", F.row_number().over(order)).where("round = _k").drop("_k")
    good = F.col("probes") >= minimum
    recall = F.when(good, F.try_divide("hits", "probes"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(recall.isNotNull(), F.struct(recall.alias("recall"), (-F.col("round")).alias("at")))).over(before)
    judged = own.withColumn("_b", best).withColumn("_bad", F.coalesce(F.col("_b.recall") - recall >= drop - TOLERANCE, F.lit(False)))
    halted = F.coalesce(F.max("_bad").over(before), F.lit(False))
    decision = F.when(halted, "after_halt").when(~good, "inadmissible").when(F.col("_bad"), "halt_rollback").otherwise("continue")
    return judged.select("run", "round", "hits", "probes", F.col("_b.recall").alias("best_prior"), (-F.col("_b.at")).alias("best_round"), decision.alias("decision"))


class RoundWatch(StatefulProcessor):
    """Decides the rounds of a run in their order. What has been decided is one value;
    rounds that came before an earlier one wait in a list. A round is decided once:
    when it comes again it changes nothing."""

    def __init__(self, drop: float, minimum: int):
        self.drop, self.minimum = drop, minimum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "next long, best double, best_round long, halted boolean")
        self.waiting = handle.getListState("waiting", "round long, hits long, probes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        nxt, best, best_round, halted = self.done.get() if self.done.exists() else (1, None, None, False)
        waiting: dict[int, tuple[int, int]] = {}

        def take(round_: int, hits: int, probes: int) -> None:
            if round_ >= nxt:
                waiting[round_] = min(waiting.get(round_, (hits, probes)), (hits, probes))

        for r in self.waiting.get() if self.waiting.exists() else ():
            take(*map(int, r))
        for batch in rows:
            for r in zip(batch["round"], batch["hits"], batch["probes"], strict=True):
                take(*map(int, r))
        out = []
        while nxt in waiting:
            hits, probes = waiting.pop(nxt)
            recall = hits / probes if probes >= self.minimum and probes else None
            bad = best is not None and recall is not None and best - recall >= self.drop - TOLERANCE
            decision = "after_halt" if halted else "inadmissible" if probes < self.minimum else "halt_rollback" if bad else "continue"
            out.append((int(key[0]), nxt, hits, probes, best, best_round, decision))
            halted = halted or bad
            if recall is not None and (best is None or recall > best):
                best, best_round = recall, nxt
            nxt += 1
        self.done.update((nxt, best, best_round, halted))
        if waiting:
            self.waiting.put([(k, *v) for k, v in sorted(waiting.items())])
        else:
            self.waiting.clear()
        columns = [x.split()[0] for x in DECISIONS.split(", ")]
        frame = pd.DataFrame(out, columns=columns)
        yield frame.astype({"best_prior": "float64", "best_round": "Int64"})

    def close(self) -> None:
        pass


def watch_rounds(spark: SparkSession, source: str, *, drop: float, minimum: int, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """``DECISIONS`` of all rounds in the Parquet files of ``source`` (``run, round, hits,
    probes``) that could be decided so far (R02), as ``round_outcomes`` decides them
    wherever a round comes with its first row. Files may hold rounds in any order; a run
    with the same checkpoint goes on where the last one stopped. State is kept in
    RocksDB, which the session is set to while the query runs."""
    sink, checkpoint = sink or scratch_path(spark, "rounds"), checkpoint or scratch_path(spark, "rounds-checkpoint")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        rows = spark.readStream.schema("run long, round long, hits long, probes long").parquet(source)
        out = rows.groupBy("run").transformWithStateInPandas(statefulProcessor=RoundWatch(drop, minimum), outputStructType=DECISIONS, outputMode="Append", timeMode="None")
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(DECISIONS).parquet(sink)
