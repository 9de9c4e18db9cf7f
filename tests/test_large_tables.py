"""Work that must not grow faster than its tables."""

import random

from pyspark.sql import functions as F

from leadloom.operators import discovery, drafts, identity, prompts, relational, signals, size_pages, web_hits
from leadloom.operators.relational import once_each


def test_costly_work_is_done_once_for_each_distinct_value(spark):
    calls = spark.sparkContext.accumulator(0)

    def costly(text):
        calls.add(1)
        return None if text is None else text.upper()

    rows = spark.createDataFrame([(i, [None, "", "a", "b"][i % 4], "old") for i in range(400)], "id int, text string, done string").repartition(3)
    got = once_each(rows, ["text"], lambda df: df.withColumn("done", F.udf(costly, "string")("_once0")))
    assert sorted(got.columns) == ["done", "id", "text"]
    assert sorted((r["id"], r["text"], r["done"]) for r in got.collect()) == [(i, [None, "", "a", "b"][i % 4], [None, "", "A", "B"][i % 4]) for i in range(400)]
    assert calls.value == 4


def test_equal_prompts_and_drafts_are_read_once(spark):
    text = "Find 20 software companies in Germany with 5-60 employees, CEO and LinkedIn"
    rows = spark.createDataFrame([(i, text if i % 2 else None, "{" if i % 3 else None) for i in range(12)], "id int, prompt string, draft string")
    for made in (prompts.parse(rows), drafts.judge(rows), drafts.decide(rows)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [" in plan, plan[:500]
    parsed = prompts.parse(rows).select("id", "plan.requested_count").collect()
    assert sorted((r[0], r[1]) for r in parsed) == [(i, 20 if i % 2 else None) for i in range(12)]
    decided = drafts.decide(rows).select("id", "error", "final.requested_count").collect()
    assert sorted(tuple(r) for r in decided) == [(i, "not an object", 20 if i % 2 else None) for i in range(12)]


def _places(seed, count):
    r = random.Random(seed)
    spots = [None, 0.0, 0.02, 0.04, 0.039999999999999994, -0.02, -0.0201, 1.0, float("nan"), float("inf"), -1e300]
    return [(i, r.choice(["a", "b", None]), r.choice([None, "", " Austin", "austin", "Dallas"]), r.choice(spots), r.choice(spots)) for i in range(count)]


def test_agreeing_places_are_those_of_all_pairs(spark):
    columns = "id int, key string, city string, lat double, lon double"
    found, stored = spark.createDataFrame(_places(1, 300), columns), spark.createDataFrame(_places(2, 300), columns)
    got = discovery.agreeing(found, stored, ["key"], {"n": F.count("*"), "first": F.min("id")}, {"n": F.sum, "first": F.min})
    other = stored.toDF("b", "key", "other_city", "other_lat", "other_lon")
    agree = discovery.places_agree(*(F.col(c) for c in ("city", "lat", "lon", "other_city", "other_lat", "other_lon")))
    want = found.join(other, "key").filter(agree).groupBy("id").agg(F.count("*").alias("n"), F.min("b").alias("first"))
    assert sorted(map(tuple, got.select("id", "n", "first").collect())) == sorted(map(tuple, want.collect()))


def test_stored_rows_are_summed_before_they_are_looked_up(spark):
    columns = "id int, name string, city string, lat double, lon double"
    found, stored = (spark.createDataFrame([(i, "Oak", None, None, None) for i in range(n)], columns) for n in (50, 80))
    looked = identity.lookup(found, stored, ["name"])
    plan = looked._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan.split("Join Inner", 1)[1]
    assert sorted(map(tuple, looked.collect())) == [(i, 0, "name") for i in range(50)]


def test_pairs_of_shared_keys_come_once_and_unshuffled(spark, monkeypatch):
    monkeypatch.setattr(relational, "CUT", 7)
    r = random.Random(5)
    rows = [(i % 90, [r.choice(["a", "b", "c", "d", None, "", "e"]) for _ in range(r.randrange(5))] or None) for i in range(100)]
    frame = spark.createDataFrame(rows, "id int, keys array<string>")
    made = discovery.duplicate_pairs(frame)
    held = {}
    for i, keys in rows:
        held.setdefault(i, set()).update(k for k in keys or [] if k is not None)
    want = [(a, b) for a in held for b in held if a < b and held[a] & held[b]]
    assert sorted(map(tuple, made.collect())) == sorted(want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join Inner", 1)[0]


def _sizes_of_parts(monkeypatch, **sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(relational, name, size, raising=False)


def test_pairs_of_parts_and_chunks_come_once(spark, monkeypatch):
    _sizes_of_parts(monkeypatch, CUT=3, PART=5, GROUPS=3, CHUNK=2)
    r = random.Random(8)
    rows = [(r.choice([None, *range(-40, 80)]), [r.choice(["a", "b", "c", "d", "e", f"own {i}", f"few {i % 40}"]) for _ in range(r.randrange(5))]) for i in range(160)]
    held = {}
    for i, keys in rows:
        held.setdefault(i, set()).update(keys)
    held.pop(None, None)
    want = [(a, b) for a in held for b in held if a < b and held[a] & held[b]]
    made = discovery.duplicate_pairs(spark.createDataFrame(rows, "id long, keys array<string>"))
    assert made.dtypes == [("a", "bigint"), ("b", "bigint")] and sorted(map(tuple, made.collect())) == sorted(want)


def _shuffled(spark, frame):
    """Rows of `frame`, and the bytes that are shuffled for it."""
    context = spark.sparkContext
    none = context._gateway.new_array(spark._jvm.double, 0)

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        found = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    known = max(stages(), default=-1)
    frame.write.format("noop").mode("overwrite").save()
    return frame.count(), sum(v for k, v in stages().items() if k > known)


def test_what_pairs_shuffle_grows_with_rows_not_with_pairs(spark, monkeypatch):
    _sizes_of_parts(monkeypatch, CUT=20, PART=20, GROUPS=4)
    found = []
    # Tables at size are not sent to all tasks.
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (500, 2000):
            rows = spark.range(n).select("id", F.lit("x").alias("phone"), F.concat(F.lit("own"), "id").alias("name"))
            found.append(_shuffled(spark, relational.block_pairs(rows, "id", {"phone": F.col("phone"), "name": F.col("name")})))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    (few, small), (many, large) = found
    assert (few, many) == (500 * 499 // 2, 2000 * 1999 // 2)
    assert large < 6 * small, found


def test_pairs_are_written_in_repeating_chunks(spark, tmp_path):
    k = F.col("id")
    keys = F.array(F.concat(F.lit("id:"), (k % 7).cast("string")), F.concat(F.lit("website:"), (k % 5).cast("string")))
    made = discovery.duplicate_pairs(spark.range(4000).select("id", keys.alias("keys")))
    made.write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs").count()
    shared = [sum(n * (n - 1) // 2 for n in (sum(i % m == r for i in range(4000)) for r in range(m))) for m in (7, 5, 35)]
    assert pairs == shared[0] + shared[1] - shared[2]
    written = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert written < pairs, (written, pairs)


def test_blocks_know_kinds_of_keys(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "x", ""), (3, "y", "x"), (4, "x", "x"), (5, "", "")], "id int, p string, q string")
    got = relational.block_pairs(rows, "id", {"p": F.col("p"), "q": F.col("q")}).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 4), (2, 4), (3, 4)]


def test_neighbours_before_are_those_of_all_pairs(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0.0, 0.01, 0.02, -0.01, 5.0, None]), r.choice([0.0, 0.01, 0.03, None])) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, lat double, lon double")
    made = discovery.earlier_neighbours(frame, 0.015)
    near = lambda a, b: None not in (*a[1:], *b[1:]) and abs(a[1] - b[1]) <= 0.015 and abs(a[2] - b[2]) <= 0.015
    before = {b[0]: [a[0] for a in rows if a[0] < b[0] and near(a, b)] for b in rows}
    assert sorted(map(tuple, made.collect())) == [(i, len(x), sum(x)) for i, x in sorted(before.items()) if x]


def test_pages_are_dealt_out_before_sizes_are_sought(spark):
    pages = spark.createDataFrame([(i, 1, "u", "Oak", "Oak has 30 employees" if i % 2 else "nothing") for i in range(40)], "company_id int, rank int, url string, title string, text string").coalesce(1)
    companies = spark.createDataFrame([(i, "Oak", "u", None, None) for i in range(40)], "company_id int, name string, website string, city string, state string")
    found = size_pages.findings(companies, pages)
    assert sorted((r["company_id"], r["kind"], r["low"]) for r in found.collect()) == [(i, "exact", 30) for i in range(1, 40, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition", 1)
    assert "employees" in above and "employees" not in below.split("LogicalRDD", 1)[0].split("LocalRelation", 1)[0]


def test_hits_are_judged_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def judge(i):
        calls.add(1)
        return "JOB_BOARD" if i % 2 else None

    rows = spark.createDataFrame([(i, f"x{i % 4}", f"https://a{i % 4}.example") for i in range(20)], "id long, external_id string, website string")
    kept, dropped = web_hits.collect(rows.withColumn("reason", F.udf(judge, "string")("id")), 5)
    assert [r["id"] for r in kept.collect()] == [0, 2] and {tuple(r) for r in dropped.collect()} == {("JOB_BOARD", 10), ("DUPLICATE", 8)}
    assert calls.value == 20


def test_a_persons_repeated_texts_are_read_once(spark):
    people = spark.createDataFrame([(1, "Ann Smith", "CEO", "Acme", "https://acme.example", None, None), (2, "Bob Roe", None, "Oak", None, None, None)], "id long, person string, title string, company string, website string, relation string, relation_status string")
    evidence = spark.createDataFrame([(1, n, "Ann Smith, CEO of Acme", f"https://{h}.example/x") for n, h in ((3, "b"), (2, "c"), (5, "acme"), (6, "acme"))], "id long, n long, text string, url string")
    made = signals.relationships(people, evidence)
    got = {r["id"]: (r["verdict"], r["url"]) for r in made.collect()}
    assert got == {1: ("STRONG", "https://acme.example/x"), 2: ("MISSING", None)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
