from pdpspark.operators import jobs as batch
from pdpspark.streaming import jobs as live

ROWS = [
    (1, 11, 1, "2024-01-01 00:00:00", "queued", 0), (1, 11, 2, "2024-01-01 00:01:00", "crawling", 10), (1, 11, 3, "2024-01-01 00:02:00", "crawling", 10),
    (1, 11, 4, "2024-01-01 00:03:00", "working", 40), (1, 11, 5, "2024-01-01 00:04:00", "failed", 40), (1, 11, 6, "2024-01-01 00:05:00", "ok", 100),
    (2, 21, 7, "2024-01-01 00:00:30", "working", 50), (2, 21, 8, "2024-01-01 00:09:00", "ok", 100),
]


def files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "job_id long, item long, event_id long, t string, status string, percent int").selectExpr(
        "job_id", "item", "event_id", "to_timestamp(t) ts", "status", "percent")
    for i in range(4):
        df.where(f"event_id > {i * 2} and event_id <= {i * 2 + 2}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return df, str(tmp_path / "events")


def drain(frame, name, mode, tmp_path):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(
        availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return frame.sparkSession.table(name)


def test_progress_and_states_match_batch(spark, tmp_path):
    df, path = files(spark, tmp_path)
    got = drain(live.job_progress(live.read_events(spark, path)), "progress", "append", tmp_path).collect()
    want = batch.job_progress(df, ["job_id"], ["event_id"]).collect()
    assert sorted((r.job_id, r.event_id, r.percent) for r in got) == sorted((r.job_id, r.event_id, r.percent) for r in want)
    got = drain(live.item_states(live.read_events(spark, path)), "states", "append", tmp_path).collect()
    want = batch.item_states(df, ["item"], ["event_id"]).collect()
    key = lambda r: (r.item, r.event_id, r.legal, r.state)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_snapshot_and_upsert(spark, tmp_path):
    df, path = files(spark, tmp_path)
    got = drain(live.job_snapshot(live.read_events(spark, path)), "snap", "complete", tmp_path).collect()
    assert sorted((r.job_id, r.status) for r in got) == sorted((r.job_id, r.status) for r in batch.job_snapshot(df).collect())
    upsert = live.upsert_catalog(str(tmp_path / "cat"))
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "slug string, crawled_at int, title string")
    second = spark.createDataFrame([("a", 2, "z")], "slug string, crawled_at int, title string")
    upsert(first, 0)
    upsert(second, 1)
    upsert(second, 1)
    assert sorted((r.slug, r.title) for r in live.read_catalog(spark, str(tmp_path / "cat")).collect()) == [("a", "z"), ("b", "y")]


def test_upsert_writes_only_its_buckets(spark, tmp_path):
    """A batch of one slug writes one bucket; batches out of order of age, nulls, repeated rows, an empty batch and a new column keep the table right."""
    at = tmp_path / "cat"
    upsert, kind = live.upsert_catalog(str(at), buckets=8), "slug string, crawled_at int, title string"
    rows = [(f"s{i}", 1, f"t{i}") for i in range(40)]
    upsert(spark.createDataFrame([*rows, ("s1", 1, "t1"), ("s1", 0, "old"), (None, 9, "x"), ("s2", None, "y")], kind), 0)
    assert len(list(at.glob("bucket=*/version=0"))) == 8
    for _ in range(2):
        upsert(spark.createDataFrame([("s3", 2, "new"), ("s3", 0, "older")], kind), 1)
        assert len(list(at.glob("bucket=*/version=1"))) == 1
    upsert(spark.createDataFrame([], kind), 2)
    assert not list(at.glob("bucket=*/version=2"))
    upsert(spark.createDataFrame([("s3", 1, "late", 5), ("s4", 3, "newest", 5)], kind + ", price int"), 3)
    got = {r.slug: (r.crawled_at, r.title, r.price) for r in live.read_catalog(spark, str(at)).collect()}
    want = {slug: (n, title, None) for slug, n, title in rows} | {"s3": (2, "new", None), "s4": (3, "newest", 5)}
    assert got == want


def test_one_trigger_with_many_events_in_any_order(spark, tmp_path):
    """A job's events of one trigger fill several Arrow batches and come in any order; stream and batch agree."""
    n = 10_001
    df = spark.range(n).selectExpr(
        "1L job_id", "id % 3 item", "id event_id", "timestamp_seconds(1700000000 + id) ts",
        "element_at(array('queued', 'crawling', 'working', 'failed', 'ok'), cast(1 + id % 5 as int)) status", "cast(id div 7 % 100 as int) percent")
    df.orderBy("percent", "status").coalesce(1).write.parquet(str(tmp_path / "many"))
    got = drain(live.job_progress(live.read_events(spark, str(tmp_path / "many"))), "many_progress", "append", tmp_path).collect()
    want = batch.job_progress(df, ["job_id"], ["event_id"]).collect()
    assert len(got) > 1000 and sorted((r.event_id, r.percent) for r in got) == sorted((r.event_id, r.percent) for r in want)
    got = drain(live.item_states(live.read_events(spark, str(tmp_path / "many"))), "many_states", "append", tmp_path).collect()
    want = batch.item_states(df, ["item"], ["event_id"]).collect()
    key = lambda r: (r.item, r.event_id, r.legal, r.state)
    assert len(got) == n and sorted(map(key, got)) == sorted(map(key, want))
