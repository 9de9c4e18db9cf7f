"""Late, repeated and replayed events."""

from datetime import datetime, timedelta

from leadloom.streaming import usage

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, created_at timestamp"


def put(spark, folder, rows):
    spark.createDataFrame([(e, u, START + timedelta(seconds=s)) for e, u, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_a_repeated_delivery_counts_once(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, source, [(1, 1, 0), (2, 1, 30), (2, 1, 30), (3, 2, 40)])
    fresh = lambda: usage.persist(usage.once(usage.events(spark, source, SCHEMA), "event_id", "created_at"), out, f"file://{tmp_path}/c").trigger(availableNow=True).start()
    fresh().awaitTermination(60)
    # The same events come again, with one new one, after a restart.
    put(spark, source, [(2, 1, 30), (3, 2, 40), (4, 2, 50)])
    fresh().awaitTermination(60)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, source, [(1, 1, 0), (2, 1, 10), (3, 1, 70)])
    run = lambda: usage.persist(usage.counts(usage.events(spark, source, SCHEMA), "created_at", ["user_id"]), out, f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
    run()
    put(spark, source, [(4, 1, 3600), (5, 1, 5)])
    run()
    rows = {(r["user_id"], r["window_start"], r["hits"]) for r in spark.read.parquet(out).collect()}
    assert (1, START, 3) in rows and (1, START + timedelta(minutes=1), 1) in rows and len(rows) == 2
