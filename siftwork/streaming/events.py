"""Events: resumable replay, retention, task states by batch fold and by a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Moves of a task's state machine: an event type leads from a state to the next; final states stay.
FINAL = ("success", "partial_success", "failed", "cancelled")
MOVES = {
    ("pending", "started"): "scanning", ("scanning", "scanned"): "reviewing", ("reviewing", "completed"): "success", ("reviewing", "partial"): "partial_success",
    **{(s, "failed"): "failed" for s in ("pending", "scanning", "reviewing")}, **{(s, "cancelled"): "cancelled" for s in ("pending", "scanning", "reviewing")},
}
STATES = ("pending", "scanning", "reviewing", *FINAL)


def page_after(events: DataFrame, cursor: int, limit: int, id_col: str = "id") -> DataFrame:
    """The next limit events after cursor, in order of id."""
    return events.where(F.col(id_col) > cursor).orderBy(id_col).limit(limit)


def retained(events: DataFrame, now: DataFrame | str, days: int, time_col: str = "created_at") -> DataFrame:
    """Events not older than days before now, a time as text or a table of one row (now)."""
    if isinstance(now, str):
        return events.where(F.col(time_col) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return events.join(F.broadcast(now.select(F.col("now").alias("_now")))).where(F.col(time_col) >= F.col("_now") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_now")


def client_stream(events: DataFrame, cursors: DataFrame, limit: int, final: tuple[str, ...] = ("completed", "partial", "failed", "cancelled")) -> DataFrame:
    """(task_id, place, id, frame, done): what clients that have seen the events up to their cursor are sent next.

    At most limit events of each client's task in order, none behind the first final one, which ends the stream (done); a
    heartbeat where there is nothing. cursors: task_id, cursor.
    """
    w = Window.partitionBy("task_id").orderBy("id")
    rows = events.join(cursors, "task_id").where("id > cursor").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    is_final = F.col("event_type").isin(*final)
    ended = F.coalesce(F.max(is_final).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    sent = rows.withColumn("_ended", ended).where("not _ended").select("task_id", "place", "id", frames(rows.select("id", "task_id", "event_type", "progress")).alias("frame"), is_final.alias("done"))
    idle = cursors.join(rows.select("task_id").distinct(), "task_id", "left_anti")
    return sent.unionByName(idle.select("task_id", F.lit(0).alias("place"), F.lit(None).cast("long").alias("id"), F.lit(": heartbeat\n\n").alias("frame"), F.lit(False).alias("done")))


def frames(events: DataFrame) -> Column:
    """Server-sent event text of a row: id, event, data."""
    return F.format_string("id: %d\nevent: %s\ndata: %s\n\n", "id", "event_type", F.to_json(F.struct(*[c for c in events.columns if c != "event_type"])))


def _led(event: str) -> list[int]:
    return [STATES.index(MOVES.get((s, event), s)) for s in STATES]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of a task in sorted events: where it begins, what each state is led to, progress, number of events."""
    moves = {event: _led(event) for event in {e for _, e in MOVES}}
    now, schema = None, None
    for batch in batches:
        schema, done = batch.schema, []
        for task, at, event, progress in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or now["task_id"] != task:
                if now:
                    done.append(now)
                now = {"task_id": task, "id": at, "event_type": event, "led": list(range(len(STATES))), "progress": progress, "n_events": 0}
            if move := moves.get(event):
                now["led"] = [move[s] for s in now["led"]]
            if progress is not None and (now["progress"] is None or progress > now["progress"]):
                now["progress"] = progress
            now["n_events"] += 1
        yield _told(done, schema)
    if now:
        yield _told([now], schema)


def _told(rows: list[dict], events: pa.Schema) -> pa.RecordBatch:
    fields = [*(events.field(n) for n in ("task_id", "id", "event_type")), pa.field("led", pa.list_(pa.int32())), events.field("progress"), pa.field("n_events", pa.int64())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([pa.field(f.name, f.type) for f in fields]))


def task_states(events: DataFrame) -> DataFrame:
    """(task_id, state, progress, n_events): the machine run over each task's events in order; progress never falls.

    Final states absorb what follows. Events of other types move nothing, and a task of such events only is pending.
    Events are dealt by ranges of task and id, so that a task with most of the events is cut into stretches. A stretch
    becomes one function on the states, and the functions of a task's stretches are applied in order: there are at most
    as many as ranges, however many events the task has. Equal ids go by event type; a null task is a task as well.
    """
    ship(events.sparkSession)
    order = ("task_id", "id", "event_type")
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.select(*order, "progress").repartitionByRange(*order).sortWithinPartitions(*order)
    cut = rows.mapInArrow(_stretches, f"task_id {kinds['task_id']}, id {kinds['id']}, event_type string, led array<int>, progress {kinds['progress']}, n_events long")
    parts = cut.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("id", "event_type", "led"))).alias("parts"), F.max("progress").alias("progress"), F.sum("n_events").alias("n_events"))
    state = F.aggregate("parts", F.lit(0), lambda at, part: F.get(part["led"], at))
    return parts.select("task_id", F.get(F.array(*[F.lit(s) for s in STATES]), state).alias("state"), "progress", "n_events")


def running_progress(events: DataFrame) -> DataFrame:
    """events with shown, the largest progress of their task so far."""
    w = Window.partitionBy("task_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown", F.max("progress").over(w))


def once(requests: DataFrame, order: str) -> DataFrame:
    """The first request of each user and idempotency key."""
    w = Window.partitionBy("user_id", "idempotency_key").orderBy(order)
    return requests.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def once_in_stream(requests: DataFrame, time_col: str, delay: str = "1 day") -> DataFrame:
    """The same for a stream, with state kept for delay."""
    return requests.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["user_id", "idempotency_key"])


def state_stream(events: DataFrame) -> DataFrame:
    """(task_id, state, progress, n_events) as updates of a stream of events; the same machine as task_states().

    The events of a task in a micro-batch come in several groups in no order. Of them those are kept that move a state, up
    to the first that ends every one, and sorted when all have come.
    """
    moves, ending = sorted({event for _, event in MOVES}), ("failed", "cancelled")

    def update(key: tuple, groups: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, progress, n = held.get if held.exists else ("pending", None, 0)
        moving = None
        for rows in groups:
            n += len(rows)
            if rows["progress"].notna().any():
                most = int(rows["progress"].max())
                progress = most if progress is None else max(progress, most)
            some = rows.loc[rows["event_type"].isin(moves), ["id", "event_type"]]
            moving = some if moving is None else pd.concat([moving, some])
            ends = moving.loc[moving["event_type"].isin(ending), "id"]
            moving = moving[moving["id"] <= ends.min()] if len(ends) else moving
        for event in moving.sort_values(["id", "event_type"])["event_type"] if state not in FINAL else ():
            state = MOVES.get((state, event), state)
        held.update((state, progress, n))
        yield pd.DataFrame({"task_id": [key[0]], "state": [state], "progress": pd.array([progress], "Int32"), "n_events": [n]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("task_id").applyInPandasWithState(update, "task_id long, state string, progress int, n_events long", "state string, progress int, n_events long", "update", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str) -> int:
    """Delivers the files of source that the checkpoint has not seen to sink, then stops; the number of rows delivered."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def appended(events: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends a stream of events to path, each once."""
    return events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
