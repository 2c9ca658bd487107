"""Streams over files, read to their end."""

import json

from pyspark.sql import functions as F

from corpusloom.streaming import logs


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return df.sparkSession.table(name)


def row(i, rating, at, tenant="t"):
    return json.dumps({"feedback_id": f"f{i}", "query": "q", "rating": rating, "tenant_id": tenant, "created_at": at})


def test_feedback_once_each(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([row(1, "Good", "2024-01-01T10:00:00"), row(1, "Good", "2024-01-01T10:00:00"), row(2, "down", "2024-01-01T10:05:00"), row(3, "?", "2024-01-02T09:00:00", None)]))
    rows = run(logs.feedback_stream(spark, str(tmp_path)), "feedback_once").collect()
    assert sorted((r.feedback_id, r.rating) for r in rows) == [("f1", "positive"), ("f2", "negative"), ("f3", "neutral")]


def test_rating_windows_of_a_batch_and_a_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([row(i, "ok" if i % 2 else "bad", f"2024-01-0{1 + i // 5}T1{i % 5}:00:00") for i in range(10)]))
    stream = logs.rating_windows(logs.feedback_stream(spark, str(tmp_path)))
    got = {(str(r.start)[:10], r.rating, r.n) for r in run(stream, "rating_windows").collect()}
    assert got <= {("2024-01-01", "positive", 2), ("2024-01-01", "negative", 3), ("2024-01-02", "positive", 3), ("2024-01-02", "negative", 2)} and ("2024-01-01", "negative", 3) in got


def test_new_files_once_each(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []

    def handle(batch, epoch):
        seen.extend(r.path.rsplit("/", 1)[-1] for r in batch.select("path").collect())

    for name in ("a.txt", "b.txt", "c.bin"):
        (tmp_path / "in" / name).write_text(name)
        assert logs.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "cp"), handle, "*.txt").awaitTermination(180)
    assert sorted(seen) == ["a.txt", "b.txt"]


def test_event_windows_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartition(4).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    key = lambda r: (str(r.start), r.event_type, r.n, r.total)
    want = sorted(map(key, logs.event_windows(events).collect()))
    assert sorted(map(key, run(logs.event_windows(stream), "event_windows", "complete").collect())) == want
    assert logs.sessions(events).agg(F.sum("n")).first()[0] == events.count()
