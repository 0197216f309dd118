"""Attempt logs as streams: once for each key, counters, rows at the k-th attempt, early stops, lagged scales."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, path: str, schema: str, files_each: int = 1, kind: str = "parquet") -> DataFrame:
    """T-06: a file source that takes a bounded number of files for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(kind).load(path)


def once(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """T-02: the first row of each (problem_id, attempt_index); with a watermark on ts, state is dropped behind it."""
    if watermark:
        return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["problem_id", "attempt_index"])
    return stream.dropDuplicates(["problem_id", "attempt_index"])


def progress(stream: DataFrame) -> DataFrame:
    """T-05: running counters by outcome, for update mode."""
    return stream.groupBy("success").agg(F.count("*").alias("attempts"), F.approx_count_distinct("problem_id").alias("problems"))


def windowed(stream: DataFrame, size: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """An extension: attempts and successes by event time, closed by a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))


def when_complete(stream: DataFrame, k: int) -> DataFrame:
    """T-01: one row for a problem when its k-th distinct attempt has come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, wins, done = state.get if state.exists else ([], 0, False)
        seen = set(seen)
        out = []
        for b in batches:
            for i, ok in zip(b["attempt_index"], b["success"], strict=True):
                if int(i) in seen or done:
                    continue
                seen.add(int(i))
                wins += bool(ok)
                if len(seen) == k:
                    done = True
                    out.append((int(key[0]), k, wins))
        state.update((sorted(seen), wins, done))
        yield pd.DataFrame(out, columns=["problem_id", "attempts", "successes"])

    return stream.groupBy("problem_id").applyInPandasWithState(
        step, "problem_id long, attempts long, successes long", "seen array<int>, wins int, done boolean", "append", GroupStateTimeout.NoTimeout
    )


def cancel_after_success(stream: DataFrame) -> DataFrame:
    """T-03: attempts with a flag for those that come after a success of their problem (by event_id within a micro-batch)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        solved = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values("event_id")
        flags = []
        for ok in rows["success"]:
            flags.append(solved)
            solved = solved or bool(ok)
        state.update((solved,))
        yield pd.DataFrame({"event_id": rows["event_id"], "problem_id": rows["problem_id"], "canceled": flags})

    return stream.groupBy("problem_id").applyInPandasWithState(
        step, "event_id long, problem_id long, canceled boolean", "solved boolean", "append", GroupStateTimeout.NoTimeout
    )


def resume(stream: DataFrame, path: str, checkpoint: str):
    """T-04, K-04: append to a receipt table; the checkpoint and the key make a restart write nothing twice."""
    from pyspark.errors import AnalysisException

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["problem_id", "attempt_index"])
        try:
            stored = batch.sparkSession.read.parquet(path)
        except AnalysisException:
            stored = None
        if stored is not None:
            fresh = fresh.join(stored.select("problem_id", "attempt_index"), ["problem_id", "attempt_index"], "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lagged_scale(stream: DataFrame, per_window: int = 16, decay: float = 0.9, initial: float = 0.5, epsilon: float = 1e-4) -> DataFrame:
    """T-07: rows (run, group_id, square_sum, n), in order of group_id for each run; the scale in force for each group."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scale, squares, n, groups = state.get if state.exists else (initial, 0.0, 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("group_id").itertuples():
            out.append((int(key[0]), int(r.group_id), scale))
            squares, n, groups = squares + float(r.square_sum), n + int(r.n), groups + 1
            if groups == per_window:
                scale = decay * scale + (1 - decay) * max((squares / max(n, 1)) ** 0.5, epsilon)
                squares, n, groups = 0.0, 0, 0
        state.update((scale, squares, n, groups))
        yield pd.DataFrame(out, columns=["run", "group_id", "scale"])

    return stream.groupBy("run").applyInPandasWithState(
        step, "run long, group_id long, scale double", "scale double, squares double, n long, groups int", "append", GroupStateTimeout.NoTimeout
    )
