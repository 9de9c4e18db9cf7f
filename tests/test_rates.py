"""Windows from the first hit: against single hits in order, and a stream with a restart against the table."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from leadloom.streaming import rates, usage

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "created_at timestamp, org_id int, user_id long, operation string"
LIMITS = {"minute": 2, "hour": 3, "day": 7}


def events(seed, n, span):
    rng = random.Random(seed)
    return [(START + timedelta(seconds=rng.choice([rng.randrange(span), rng.randrange(120)])), rng.randrange(2), rng.choice([1, 2, None]), rng.choice(["a", "b"])) for _ in range(n)]


def one_by_one(rows):
    """Each hit by itself, as counters with an expiry would do."""
    out, windows = Counter(), {}
    for t, org, user, op in sorted(rows, key=lambda r: r[0]):
        s = int(t.timestamp())
        key = (org, str(user) if user is not None else "anonymous", op)
        verdict = "allowed"
        for w, seconds in rates.WINDOWS.items():
            start, count = windows.get((key, w), (s, 0))
            if s >= start + seconds:
                start, count = s, 0
            windows[key, w] = (start, count + 1)
            if count + 1 > LIMITS[w]:
                verdict = f"refused_{w}"
                break
        out[key, s, verdict] += 1
    return out


def tally(rows):
    out = Counter()
    for r in rows:
        for verdict in ("allowed", *(f"refused_{w}" for w in rates.WINDOWS)):
            if r[verdict]:
                out[(r["org_id"], r["user_id"], r["operation"]), r["second"], verdict] += r[verdict]
    return out


def test_table_equals_single_hits(spark):
    rows = events(1, 400, 200_000)
    got = rates.limited(spark.createDataFrame([*rows, (None, 1, 1, "a")], SCHEMA).repartition(3), LIMITS).collect()
    assert tally(got) == one_by_one(rows) and sum(r["hits"] for r in got) == len(rows)
    assert {v.split("_")[-1] for _, _, v in tally(got)} == {"allowed", "minute", "hour", "day"}
    assert rates.limited(spark.createDataFrame([], SCHEMA), LIMITS).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = sorted(events(2, 200, 100_000), key=lambda r: r[0])
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        limited = rates.limited_stream(usage.events(spark, source, SCHEMA), LIMITS)
        usage.persist(limited, out, f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert tally(spark.read.parquet(out).collect()) == one_by_one(rows)
