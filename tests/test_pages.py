"""Facts and people of pages, places, labels: cases."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import labels
from leadloom.operators import evidence, pages, places


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


PAGE = """<html><head><title> Acme  Homes </title><meta name="description" content="We build."></head><body><nav>menu</nav><script>x</script>
<h1>Acme</h1><p>Our Services: roofs and floors. We buy houses for cash! Call (555) 010-0000 or mail INFO@acme.example.</p>
<p>12 Main Street, Suite B, Austin TX 78701</p><a href="https://www.linkedin.com/company/acme/?x=1">in</a></body></html>"""


def test_page_facts(spark):
    rows = spark.createDataFrame([(1, "https://acme.example/contact", PAGE), (2, "https://x.example", None), (3, "https://y.example", "")], "page_id int, url string, html string")
    facts = {r["page_id"]: r["facts"] for r in pages.page_facts(rows).collect()}
    f = facts[1]
    assert (f["company_name"], f["description"], f["phone"], f["public_email"]) == ("Acme Homes", "We build.", "(555) 010-0000", "info@acme.example")
    assert f["investment_signals"] == ["We buy houses for cash"] and f["social_links"] == ["https://linkedin.com/company/acme"] and f["services"][0].startswith(": roofs and floors.")
    assert facts[3]["company_name"] is None and facts[2]["phone"] is None
    rows = pages.evidence_rows(pages.page_facts(rows), ["page_id"]).collect()
    assert {(r["page_id"], r["field"], r["value"]) for r in rows} >= {(1, "description", "We build."), (1, "publicEmail", "info@acme.example"), (1, "phone", "(555) 010-0000")}


def test_pages_fill_only_empty_columns(spark):
    companies = spark.createDataFrame([(1, "Acme", None, " "), (2, "Bee", "555", None)], "id int, name string, phone string, email string")
    facts = spark.createDataFrame([(1, 2, "222", "b@x.example"), (1, 1, "111", None), (2, 1, "999", None)], "company_id int, n int, phone string, public_email string").select("company_id", "n", F.struct("phone", "public_email").alias("facts"))
    got = {r["id"]: (r["phone"], r["email"]) for r in pages.fill_empty(companies, facts, {"phone": "phone", "email": "public_email"}).collect()}
    assert got == {1: ("111", "b@x.example"), 2: ("555", None)}


@pytest.mark.parametrize("name, clean", [("Our Team Ann Smith", "Ann Smith"), ("Ann  Smith", "Ann Smith"), ("About Our Team", "About Our Team")])
def test_names(spark, name, clean):
    assert one(spark, name, pages.clean_name) == clean


def test_people(spark):
    text = "Welcome Ann Smith, our CEO and Managing Director. " + "x " * 200 + "Bob Jones likes tea. " + "y " * 200 + "The Carl Moe is Co-Founder. Ann Smith is the CEO."
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    found = {(r["full_name"], r["title"]) for r in pages.people_in_windows(docs, ["CEO", "managing director"], ["id"]).collect()}
    assert ("Ann Smith", "CEO") in found and ("Bob Jones", None) in found
    spoken = {(r["name"], r["title"]) for r in pages.people_in_sentences(docs, ["CEO", "CO_FOUNDER", "FOUNDER"], ["id"]).collect()}
    assert ("Carl Moe", "CO FOUNDER") in spoken and ("Ann Smith", "CEO") in spoken
    assert one(spark, "She is a regional  manager here", pages.stated_title) == "Regional Manager" and one(spark, "the Founder", pages.stated_title) == "FOUNDER"
    html = '<p>Ann Smith <a href="https://linkedin.com/in/ann">me</a></p>' + "<p>filler text</p>" * 60 + '<a href="https://linkedin.com/in/bob">b</a>'
    linked = pages.profile_links(spark.createDataFrame([(1, "https://acme.example", html)], "id int, url string, html string"), spark.createDataFrame([(1, "Ann Smith")], "id int, name string"), ["id"]).collect()
    assert [r["url"] for r in linked] == ["https://linkedin.com/in/ann"]


def test_places(spark):
    assert [one(spark, x, places.country_code) for x in ("USA", " Deutschland ", "zz", "Atlantis", None)] == ["US", "DE", "ZZ", None, None]
    square = [(0, 0), (0, 4), (4, 4), (4, 0)]
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 0.1)], "lat double, lon double")
    assert [r[0] for r in points.select(places.inside(F.col("lat"), F.col("lon"), square)).collect()] == [True, False, True]


def test_failures_show_nothing_private(spark):
    code, message, retry = labels.failure(F.col("x"))
    rows = spark.createDataFrame([("timeout: api_key=1",), ("odd",), (None,)], "x string").select(code, message, retry).collect()
    assert [tuple(r) for r in rows] == [("TRANSIENT_PROVIDER_ERROR", labels.PLAIN, True), ("INTERNAL_ERROR", labels.PLAIN, False), ("INTERNAL_ERROR", labels.PLAIN, False)]
    assert one(spark, "HTTP 404 Not", labels.page_failure) == "PERMANENT" and one(spark, "reset", labels.page_failure) == "TRANSIENT"


def test_evidence_is_merged_once(spark):
    schema = "id string, url string, excerpt string, kind string"
    a = spark.createDataFrame([("1", "u", "x", "k"), (None, "u", "x", "k")], schema)
    b = spark.createDataFrame([("1", "other", "y", "k"), (None, "u", "x", "k"), (None, None, None, None)], schema)
    assert {tuple(r) for r in evidence.merge_evidence([a, b]).collect()} == {("1", "u", "x", "k"), (None, "u", "x", "k"), (None, None, None, None)}
