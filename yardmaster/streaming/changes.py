"""Change streams over update logs, in batch and as Structured Streaming.

A log has (seq, key, ...attributes). A constraint turns it into changes: an ad that
matches is an upsert; one that did and no longer does is a delete; others are silent.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expressions import Compiler, attributes
from ..operators.store import DEFAULT_LIFETIME, latest

UPSERT, DELETE, RESET, SYNCED, RESYNC = 0, 1, 2, 3, 4


def changes(log: DataFrame, constraint: str = "", after: int | None = None) -> DataFrame:
    """`log` as changes (kind added), those after the cursor `after` only: of what lies before it, one
    aggregated row a key is needed, and no sort."""
    by = Window.partitionBy("key").orderBy("seq")
    matched = log.withColumn("_match", Compiler(attributes(log)).predicate(constraint))
    was = F.lit(False)
    if after is not None:
        held = matched.filter(F.col("seq") <= after).groupBy("key").agg(F.max_by("_match", "seq").alias("_was")).filter("_was")
        matched, was = matched.filter(F.col("seq") > after).join(held, "key", "left"), F.coalesce("_was", F.lit(False))
    before = F.coalesce(F.lag("_match").over(by), was)
    kind = F.when(F.col("_match"), UPSERT).when(before, DELETE)
    return matched.withColumn("kind", kind).filter("kind is not null").drop("_match", "_was")


def replay(log: DataFrame, constraint: str = "", cursor: int | None = None) -> DataFrame:
    """A watch's events (kind, key, cursor): all anew without a cursor, else what came after it, then synced."""
    end = log.agg(F.max("seq").alias("cursor")).select(F.lit(SYNCED).alias("kind"), F.lit(None).cast("string").alias("key"), "cursor")
    if cursor is not None:
        events = changes(log, constraint, cursor).select("kind", F.col("key").cast("string").alias("key"), F.col("seq").alias("cursor"))
        return events.unionByName(end)
    now = latest(log, order=["seq"])
    held = now.filter(Compiler(attributes(now)).condition(constraint)).select(F.lit(UPSERT).alias("kind"), F.col("key").cast("string").alias("key"), F.col("seq").alias("cursor"))
    begin = log.limit(1).select(F.lit(RESET).alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("cursor"))
    return begin.unionByName(held).unionByName(end)


def resume_point(deletes_kept: int, deleted_since: int) -> int:
    """RESYNC if more was deleted since a cursor than is kept, else UPSERT: the stream goes on."""
    return RESYNC if deleted_since > deletes_kept else UPSERT


def stream_changes(updates: DataFrame, constraint: str = "", lifetime_ms: int | None = None) -> DataFrame:
    """Streaming (key, seq, kind) of `updates` (key string, seq long, ...), keyed state holding whether each key matched.

    Within a batch rows are taken in order of seq. With `lifetime_ms`, a key not
    heard of that long is deleted by a timer.
    """
    rows = updates.select(F.col("key").cast("string").alias("key"), "seq", Compiler(attributes(updates)).predicate(constraint).alias("match"))

    def step(key, frames, state: GroupState):
        matched, last = state.get if state.exists else (False, -1)
        out = []
        if state.hasTimedOut:
            state.remove()
            if matched:
                yield pd.DataFrame({"key": [key[0]], "seq": [last], "kind": [DELETE]})
            return
        for seq, match in sorted((s, bool(m)) for f in frames for s, m in zip(f["seq"], f["match"])):
            if match or matched:
                out.append((key[0], seq, UPSERT if match else DELETE))
            matched, last = match, seq
        state.update((matched, last))
        if lifetime_ms is not None:
            state.setTimeoutDuration(lifetime_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "kind"]).astype({"seq": "int64", "kind": "int32"})

    timeout = GroupStateTimeout.NoTimeout if lifetime_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(step, "key string, seq long, kind int", "matched boolean, last long", "append", timeout)


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, most_files: int | None = None, trigger: dict | None = None):
    """Micro-batches to Parquet, the last update of each key in each; a batch written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, order=["seq"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that `upsert_stream` has written so far: the last batch's row of each key."""
    return latest(spark.read.parquet(path), order=["batch", "seq"]).drop("batch")


def fan_out(updates: DataFrame, paths: list[str], checkpoint: str, most: int | None = None):
    """Forward each batch's public ads to several views, whole unless `most` ads of a batch are asked for.
    A view that fails doesn't stop the others; the batch then fails, and a new start does it again."""

    def write(batch: DataFrame, number: int) -> None:
        sent, failed = batch if most is None else batch.orderBy("seq").limit(most), {}
        for path in paths:
            try:
                sent.write.mode("overwrite").parquet(f"{path}/batch={number}")
            except Exception as e:
                failed[path] = e
        if failed:
            raise RuntimeError(f"batch {number} missed views: {failed}")

    return updates.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def swept(table: DataFrame, now_column: str = "now", lifetime: str = "AdLifetime") -> DataFrame:
    """Ads still alive at the time in `now_column`: what a periodic sweep leaves."""
    own = F.coalesce(F.col(lifetime), F.lit(DEFAULT_LIFETIME)) if lifetime in table.columns else F.lit(DEFAULT_LIFETIME)
    return table.filter(~F.coalesce(F.col(now_column) - F.col("LastHeardFrom") > own, F.lit(False)))
