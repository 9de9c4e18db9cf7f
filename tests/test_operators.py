import random
import re
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadloom.functions import size, text, urls
from leadloom.operators import discovery, evidence, export, leads, relational
from leadloom.plans import activity_queries, catalogue
from leadloom.plans.search_plan import SearchPlan, parse_prompts
from leadloom.streaming import usage as stream


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, expected", [("HTTP://www.Example.com/?utm_source=x", "example.com"), ("example.com/a", "example.com"), ("not a url ::", None), (None, None)])
def test_host(spark, raw, expected):
    assert one(spark, raw, urls.host) == expected


def test_canonical_urls(spark):
    assert one(spark, "http://www.linkedin.com/company/example/?ref=copy", urls.social_url) == "https://linkedin.com/company/example"
    assert one(spark, "https://www.Example.com/about/?utm_source=ad#team", urls.research_url) == "https://example.com/about"
    assert one(spark, "https://www.fixture-northwind.test/about/", urls.source_url) == "https://fixture-northwind.test/about/"
    assert one(spark, "https://a.b.example.co.uk/x", urls.registrable_domain) == "example.co.uk"


def test_names_and_phones(spark):
    assert one(spark, "ABC Home Buyers, LLC", lambda c: text.company_name(text.normal_text(c))) == "abc home buyers"
    assert one(spark, "résumé", text.normal_text) == "re sume"
    assert one(spark, "+1 (555) 010-0000", text.national_phone) == "5550100000"
    assert one(spark, "+1 (415) 555-0100", text.contact_phone) == "+14155550100"


def test_sizes(spark):
    assert tuple(one(spark, "Company size: 11-50 employees", size.extract)) == ("range", 11, 50)
    assert one(spark, "3.3 Employee stealing from clients", size.extract) is None


@pytest.mark.parametrize("values, expected", [(["https://c.test/team", "https://c.test/about"], "SUPPORTED"), (["https://c.test/team", "https://d.test/x"], "VERIFIED")])
def test_claims_by_independent_sources(spark, values, expected):
    claims = spark.createDataFrame([(i, 1, "title", "Founder", u, None) for i, u in enumerate(values)], "id int, company_id int, field string, value string, source_url string, provider string")
    stored = spark.createDataFrame([(1, "title", "founder")], "company_id int, field string, value string")
    assert evidence.reconcile(claims, stored).first()["status"] == expected


def test_two_values_conflict_and_a_missing_one_is_not_found(spark):
    claims = spark.createDataFrame([(1, 1, "title", "Founder", "https://c.test", None), (2, 1, "title", "President", "https://d.test", None)], "id int, company_id int, field string, value string, source_url string, provider string")
    stored = spark.createDataFrame([(1, "title", "Founder"), (2, "title", None)], "company_id int, field string, value string")
    got = {r["company_id"]: r for r in evidence.reconcile(claims, stored).collect()}
    assert (got[1]["status"], got[1]["conflict_a"], got[1]["conflict_b"]) == ("NEEDS_REVIEW", "Founder", "President")
    assert got[2]["status"] == "NOT_FOUND"


def test_cells(spark):
    for raw, cell in (("=1+2", "'=1+2"), ("safe", "safe"), (None, "NOT_FOUND"), ("a\tb", "a\tb"), ("\tx", "'\tx")):
        assert one(spark, raw, export.safe_cell) == cell
    assert one(spark, 'ACME, "North"\nHoldings', export.csv_cell) == '"ACME, ""North""\nHoldings"'


def test_csv_files(spark, tmp_path):
    rows = spark.createDataFrame([("=a", None), ("b", 3)], "name string, employee_count int").coalesce(1)
    export.write_csv(rows, ["name", "employee_count"], str(tmp_path / "out"))
    written = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert written == b"'=a,UNKNOWN\r\nb,3\r\n"


def test_streaks_and_greedy_first_wins(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([0, 1, 0, 0, 0])], "family string, batch int, accepted int")
    got = [r["streak"] for r in relational.streaks(rows, ["family"], ["batch"], F.col("accepted") > 0).orderBy("batch").collect()]
    assert got == [1, 0, 1, 2, 3]
    found = spark.createDataFrame([(1, 0, ["a"]), (2, 0, ["a", "b"]), (3, 0, ["b"]), (4, 1, ["a"])], "id int, block int, keys array<string>")
    # The second is dropped, and its other key is not remembered.
    assert sorted(r["id"] for r in discovery.first_wins(found, "block").collect()) == [1, 3, 4]


def greedy(rows):
    seen, kept = set(), []
    for i, keys in rows:
        if not seen.intersection(keys or ()):
            seen.update(keys or ())
            kept.append(i)
    return sorted(kept)


def test_first_wins_in_rounds_equals_one_pass(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 50 == 7 else rng.sample("abcdefghijklmnopqrstuvwxyz0123456789", rng.randint(0, 3)), rng.randint(0, 2)) for i in range(150)]
    # The last is a repeated row.
    rows.append(rows[20])
    found = spark.createDataFrame(rows, "id int, keys array<string>, filled int").repartition(3)
    by_id = sorted(rows, key=lambda r: r[0])
    assert sorted(r["id"] for r in discovery.first_wins(found).collect()) == greedy((r[0], r[1]) for r in by_id)
    ranked = sorted(by_id, key=lambda r: -r[2])
    assert sorted(r["id"] for r in discovery.first_wins(found, order=[-F.col("filled")]).collect()) == greedy((r[0], r[1]) for r in ranked)


def test_greedy_queries_compare_all_candidates(spark, sf_dir):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    keys = {i: [f"id{i % 211}", f"site{i % 173}"] for i in ids}
    filled = lambda i: 1 + sum(i % n == 0 for n in (2, 3, 5, 7, 11))
    assert sorted(r["id"] for r in activity_queries.discovery_dedupe_greedy(spark, sf_dir).collect()) == greedy((i, keys[i]) for i in ids)
    got = activity_queries.discovery_dedupe_ranked(spark, sf_dir).collect()
    assert sorted(r["id"] for r in got) == greedy((i, keys[i]) for i in sorted(ids, key=lambda i: (-filled(i), i)))
    assert all(r["completeness"] == filled(r["id"]) for r in got)


def test_queries_over_whole_tables(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    claims = {r["company_id"]: r["claims"] for r in catalogue.QUERIES["entity_agreement_all"](spark, sf_dir).collect()}
    assert claims == {r["o_custkey"]: r["count"] for r in table("orders").groupBy("o_custkey").count().collect()}
    shown = catalogue.QUERIES["latest_verification_breakdown_all"](spark, sf_dir)
    assert {r[0] for r in shown.select(F.col("company_id") % 3).distinct().collect()} == {0, 1, 2}
    placed = [(r["priority"], r["id"]) for r in catalogue.QUERIES["role_priority_all"](spark, sf_dir).collect()]
    places = {0: 3, 1: 2, 2: 99, 3: 1}
    assert placed == sorted((places[r[0] % 4], r[0]) for r in table("supplier").select("s_suppkey").collect())


def test_normal_text_of_all_documents(spark, tmp_path):
    texts = ["Plain, ASCII text!", "Das Gebäude  für Bücher", "“Curly” quotes’ end", "ﬁne ＷＩＤＥ Ⅳ ½ x²", "a\u00a0b\u2003c\u2028d\ufeffe", "İstanbul ŒUVRE ß", "日本語 text", "e\u0301te\u0301", " \t\n", "", None]
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("en", "de", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))

    def plain(text):
        kept = re.sub(r"[^a-z0-9\s]", " ", unicodedata.normalize("NFKD", (text or "").lower()))
        return " ".join(kept.split())

    got = {r["doc_id"]: r["plain"] for r in catalogue.QUERIES["text_normalize"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(t) for i, t, _ in rows}


def test_pages_and_filters_are_checked(spark):
    with pytest.raises(ValueError):
        relational.page(spark.range(3), [F.col("id")], 0, 10)
    with pytest.raises(ValueError):
        leads.LeadFilter(1, min_score=200)


def test_page_reads_only_what_it_shows(spark, sf_dir):
    from leadloom.plans import catalogue

    plan = catalogue.QUERIES["leads_page_by_score"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_prompts_and_plans(spark):
    row = parse_prompts(spark.createDataFrame([("Find up to 50 real estate investment companies in Texas with company size 1-50 employees",), (None,)], "text string"), "text").first()
    assert (row["max_results"], row["size_min"], row["size_max"], row["place"]) == (50, 1, 50, "Texas")
    assert SearchPlan(max_results=2).query_budget() == 8 and SearchPlan().query_budget() == 1000


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i % 20, i % 3, start + timedelta(seconds=20 * (i % 20))) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    # Each event comes twice and counts once.
    unique = stream.once(stream.events(spark, str(tmp_path / "in"), events.schema), "event_id", "ts")
    query = unique.writeStream.format("memory").queryName("seen_once").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen_once").count() == 20
    counted = stream.counts(stream.events(spark, str(tmp_path / "in"), events.schema), "ts", ["user_id"])
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = events.groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("hits")).select("user_id", F.col("w.start").alias("window_start"), "hits")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))
