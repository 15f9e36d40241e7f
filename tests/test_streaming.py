from pyspark.sql import functions as F

from siftwork.streaming import events

SHAPE = "id long, task_id long, event_type string, progress int"
ROWS = [(1, 1, "started", 10), (2, 1, "scanned", 40), (3, 2, "started", 5), (4, 1, "completed", 100), (5, 1, "failed", 0), (6, 2, "cancelled", 5), (7, 3, "note", 0)]


def test_states(spark):
    df = spark.createDataFrame(ROWS, SHAPE)
    want = [(1, "success", 100, 4), (2, "cancelled", 5, 2), (3, "pending", 0, 1)]
    assert [tuple(r) for r in events.task_states(df).orderBy("task_id").collect()] == want
    assert [r["shown"] for r in events.running_progress(df).where("task_id = 1").orderBy("id").collect()] == [10, 40, 100, 100]
    assert [r["id"] for r in events.page_after(df, 3, 2).collect()] == [4, 5]


def test_state_stream_agrees_with_the_fold(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame(ROWS[4 * k : 4 * k + 4], SHAPE).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SHAPE).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = events.state_stream(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("SELECT task_id, max_by(state, n_events) AS state, max(n_events) AS n FROM states GROUP BY task_id ORDER BY task_id")
    assert [(r["task_id"], r["n"]) for r in last.collect()] == [(1, 4), (2, 2), (3, 1)]


def test_replay_resumes(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SHAPE)
    df.where("id < 4").write.mode("append").parquet(f"{tmp_path}/in")
    first = events.replay(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", SHAPE)
    df.where("id >= 4").write.mode("append").parquet(f"{tmp_path}/in")
    second = events.replay(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", SHAPE)
    assert (first, second) == (3, 4) and sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(1, 8))


def test_retention_and_frames(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-08")], "id long, event_type string, at string").withColumn("created_at", F.col("at").cast("timestamp"))
    assert [r["id"] for r in events.retained(df, "2024-01-09 00:00:00", 7).collect()] == [2]
    small = df.select("id", "event_type")
    assert small.select(events.frames(small)).first()[0] == 'id: 1\nevent: a\ndata: {"id":1}\n\n'


def test_requests_once(spark):
    df = spark.createDataFrame([(1, "k", 5), (1, "k", 3), (2, "k", 4)], "user_id long, idempotency_key string, id long")
    assert sorted(r["id"] for r in events.once(df, "id").collect()) == [3, 4]


def test_live_streams_go_on_after_a_restart(spark, tmp_path):
    """Clients that come late get what follows; a client without events gets heartbeats; nothing follows a final event."""
    from siftwork.streaming import tasks

    def went(events, clients):
        e, c = (spark.createDataFrame(rows, shape) for rows, shape in ((events, SHAPE), (clients, "task_id long, cursor long")))
        e.write.mode("append").parquet(f"{tmp_path}/e"), c.write.mode("append").parquet(f"{tmp_path}/c")
        stream = tasks.client_frames(*(spark.readStream.schema(x.schema).parquet(f"{tmp_path}/{n}") for x, n in ((e, "e"), (c, "c"))), limit=3)
        tasks.run(stream, f"{tmp_path}/k", f"{tmp_path}/out", once=True)
        return sorted((r["task_id"], r["place"], r["id"], r["done"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert went(ROWS[:2], [(1, 1), (9, 0)]) == [(1, 1, 2, False)]
    assert went(ROWS[2:5], []) == [(1, 1, 2, False), (1, 2, 4, True), (9, 0, None, False)]
    assert went(ROWS[5:], [(3, 0)])[:2] == [(1, 1, 2, False), (1, 2, 4, True)]


def test_requests_of_a_restarted_stream(spark, tmp_path):
    from siftwork.streaming import tasks

    shape = "user_id long, idempotency_key string, id long"
    for rows in ([(1, "k", 5), (1, "k", 3), (2, None, 4)], [(1, "k", 9), (2, None, 6), (2, "k", 7)]):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(f"{tmp_path}/in")
        tasks.run(tasks.first_requests(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")), f"{tmp_path}/k", f"{tmp_path}/out")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [3, 4, 7]


def test_states_of_one_task_with_most_events(spark):
    kinds = ["note", "started", "note", "scanned", "started", "completed", "failed"]
    hot = [(k, 9, kinds[min(k // 3000, 6)], k % 90) for k in range(21000)]
    df = spark.createDataFrame([*hot, *[(i, t, e, p) for i, t, e, p in ROWS], (1, None, "started", None), (2, 4, None, None)], SHAPE)
    got = {r["task_id"]: (r["state"], r["progress"], r["n_events"]) for r in events.task_states(df.repartition(7)).collect()}
    assert got == {9: ("success", 89, 21000), 1: ("success", 100, 4), 2: ("cancelled", 5, 2), 3: ("pending", 0, 1), None: ("scanning", None, 1), 4: ("pending", None, 1)}
    assert events.task_states(df.where("false")).count() == 0


def test_state_stream_sorts_over_all_groups_of_a_batch(spark, tmp_path):
    """A task's events of one batch come in several groups and not in order; types and progress may be missing."""
    from siftwork.streaming import tasks

    rows = [(k, 1, {4: "started", 900: "scanned", 1700: "completed", 1900: "failed"}.get(k, "note"), None) for k in range(2000, 0, -1)]
    rows += [(1, 2, "started", 7), (2, 2, None, None)]
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        tasks.run(events.state_stream(spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")), f"{tmp_path}/k", f"{tmp_path}/out", "update")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted(tuple(r)[:4] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "success", None, 2000), (2, "scanning", 7, 2)]


def test_least_requests_of_a_restarted_stream(spark, tmp_path):
    """Every key once with its least id, over a restart; no key is handed to Python."""
    from siftwork.streaming import tasks

    shape = "user_id long, idempotency_key string, id long"
    for rows in ([(1, "k", 5), (1, "k", 3), (2, None, 4)], [(1, "k", 9), (2, None, 6), (2, "k", 7)]):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(f"{tmp_path}/in")
        stream = tasks.least_requests(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"))
        assert "Pandas" not in stream._jdf.queryExecution().logical().toString()
        tasks.run(stream, f"{tmp_path}/k", f"{tmp_path}/out", "update")
    least = spark.read.parquet(f"{tmp_path}/out").groupBy("user_id", "idempotency_key").agg(F.min("id").alias("id"))
    assert sorted(r["id"] for r in least.collect()) == [3, 4, 7]


def test_client_frames_are_made_of_what_is_sent(spark):
    """Texts of events are made behind the state, for the few that are sent."""
    from siftwork.streaming import tasks

    stream = spark.readStream.format("rate").load()
    e = stream.selectExpr("value AS id", "value AS task_id", "'note' AS event_type", "1 AS progress")
    plan = tasks.client_frames(e, stream.selectExpr("value AS task_id", "0L AS cursor"), 3)._jdf.queryExecution().analyzed().toString()
    assert plan.index("format_string") < plan.index("FlatMapGroupsInPandasWithState") and plan.count("format_string") == 1
