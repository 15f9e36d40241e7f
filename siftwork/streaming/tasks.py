"""Tasks, clients and requests as streams that keep state: restarts, timeouts, keys that expire.

Each stream keeps a few values a key; no key's events are ever held together. Rows of a key come one micro-batch at a time,
here in order of id; a restarted stream goes on where its checkpoint ends.

The state is kept by applyInPandasWithState. transformWithState was tried with the noop and memory sinks and failed while
its plan was made (the session of the plan node is null); the same happened here with the Parquet sink, not in batches.

Edge cases: an event without a type or progress changes neither; events after a client's final one, or beyond its limit,
are passed over; so are events that come before their client, which are its replay (events.client_stream); a request
without a key is a request of the key null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import ship
from .events import frames

#: Event types behind which a client's stream ends; milliseconds of silence after which it gets a heartbeat.
LAST, SILENCE = ("completed", "partial", "failed", "cancelled"), 1
#: Where streams keep their state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def client_frames(events: DataFrame, cursors: DataFrame, limit: int, silence: int = SILENCE) -> DataFrame:
    """(task_id, place, id, frame, done) of a stream of events (id, task_id, event_type, progress) and one of clients
    (task_id, cursor) that come.

    A client is sent the events after its cursor, at most limit, none behind a final one; a heartbeat each time silence
    passes before its first event.
    """
    own = events.select("task_id", F.lit(True).alias("event"), F.col("id").cast("long").alias("id"), "event_type", F.col("progress").cast("long").alias("progress"))
    came = cursors.select("task_id", F.lit(False).alias("event"), F.col("cursor").cast("long").alias("id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("long").alias("progress"))
    shape = "task_id long, place int, id long, event_type string, progress long, done boolean"

    def sent(key: tuple, groups: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        told: list[tuple] = []
        cursor, n, ended = held.get if held.exists else (None, 0, False)
        if held.hasTimedOut:
            told.append((key[0], 0, None, None, None, False))
        rows = None
        for group in groups:
            asked = group.loc[~group["event"], "id"].dropna()
            cursor = int(asked.iloc[0]) if cursor is None and len(asked) else cursor
            some = group.loc[group["event"] & group["id"].notna(), ["id", "event_type", "progress"]]
            rows = some if rows is None else pd.concat([rows, some])
            if cursor is not None:  # from now on the next events are enough
                rows = rows[rows["id"] > cursor].sort_values(["id", "event_type", "progress"]).drop_duplicates("id").head(0 if ended else limit - n)
        if rows is not None and cursor is not None:
            for number, event, progress in rows.itertuples(index=False, name=None):
                if not ended:
                    cursor, n, ended = int(number), n + 1, event in LAST
                    told.append((key[0], n, cursor, event, None if pd.isna(progress) else int(progress), ended))
        if cursor is not None:
            held.update((cursor, n, ended))
            if not n:
                held.setTimeoutDuration(silence)
        if told:
            out = pd.DataFrame(told, columns=["task_id", "place", "id", "event_type", "progress", "done"])
            yield out.astype({"id": "Int64", "progress": "Int64"})

    out = own.unionByName(came).groupBy("task_id").applyInPandasWithState(sent, shape, "cursor long, sent int, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
    frame = F.when(F.col("id").isNull(), ": heartbeat\n\n").otherwise(frames(out.select("id", "task_id", "event_type", "progress")))
    return out.select("task_id", "place", "id", frame.alias("frame"), "done")


def first_requests(requests: DataFrame) -> DataFrame:
    """The first request (user_id, idempotency_key, id) of each user and key of a stream."""

    def first(key: tuple, groups: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        known, least = held.exists, min(int(group["id"].min()) for group in groups)
        if not known:
            held.update((least,))
        yield pd.DataFrame({"user_id": [] if known else [key[0]], "idempotency_key": [] if known else [key[1]], "id": [] if known else [least]})

    return requests.groupBy("user_id", "idempotency_key").applyInPandasWithState(first, "user_id long, idempotency_key string, id long", "id long", "append", GroupStateTimeout.NoTimeout)


def least_requests(requests: DataFrame) -> DataFrame:
    """(user_id, idempotency_key, id) as updates of a stream of requests: the least id so far of each user and key.

    An aggregate that keeps one number a key; no row of a key reaches Python. The last update of a key is its least id.
    """
    return requests.groupBy("user_id", "idempotency_key").agg(F.min("id").alias("id"))


def run(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append", once: bool = False) -> int:
    """Runs a stream over what its sources hold beyond its checkpoint, then ends; the rows it read. What it gives, appended
    rows or updates, is added to the folder sink as rows of their batch (batch).

    State is kept by RocksDB, on the disks of the executors and within a bounded memory, as keys may be many.
    A batch that is run again after a failure replaces what it had written. once: as a single batch, for streams whose
    timeouts would start batch after batch.
    """
    ship(stream.sparkSession)
    out = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(**({"once": True} if once else {"availableNow": True}))
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        conf.set(name, value)
    try:
        query = out.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{sink}/batch={n}")).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
