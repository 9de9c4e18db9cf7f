"""Web hits: accepted candidates and the reasons of the others."""

import pytest
from pyspark.sql import functions as F

from leadloom.operators import web_hits

PLAN = {"kinds": ["real_estate_investor"], "state": "Texas", "country": "US"}


@pytest.mark.parametrize(
    "title, url, snippet, reason",
    [
        ("Acme Investments - Home", "https://acme.example/?x=1", "Investors in Austin, Texas", None), ("Acme Investments", "https://acme.example", "We buy houses", None), ("Acme Investments", "https://acme.example", "Investors in Ohio", "OUTSIDE_REQUESTED_LOCATION"),
        ("Top 10 investors", "https://acme.example", "in Texas", "GENERIC_LIST"), ("Home", "https://acme.example", "investors in Texas", "UNUSABLE_NAME"), ("Jobs", "https://www.indeed.com/x", "Texas", "JOB_BOARD"), ("Acme", "https://yelp.com/acme", "Texas", "REVIEW_SITE"),
        ("Acme", "mailto:a", "Texas", "INVALID_URL"), ("Bella Restaurant", "https://bella.example", "a restaurant in Texas", "NOT_REAL_ESTATE_INVESTOR"), ("Acme Investments", "https://acme.example/blog/a", "Texas", "GENERIC_LIST"),
    ],
)
def test_hits(spark, title, url, snippet, reason):
    hits = spark.createDataFrame([(title, url, snippet)], "title string, url string, snippet string")
    got = web_hits.assess(hits, **PLAN).first()
    assert got["reason"] == reason
    if reason is None:
        assert (got["name"], got["website"]) == ("Acme Investments", "https://acme.example") and len(got["external_id"]) == 40


def test_places_in_texts(spark):
    texts = ["homes in TX now", "homes in tx now", "in texas", "AUSTIN", "nowhere", "Deutschland"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    us = web_hits.place_mentioned(F.col("x"), web_hits.place_words(None, "Texas", "US"), ["Austin"])
    assert [r[0] for r in rows.select(us).collect()] == ["TX", None, "Texas", "Austin", None, None]
    german = web_hits.place_mentioned(F.col("x"), web_hits.place_words(None, None, "Germany"))
    assert [r[0] for r in rows.select(german).collect()][-1] == "Deutschland"
    assert [r[0] for r in rows.select(web_hits.foreign_state(F.lit("from Ohio"), "Texas")).collect()][0]


def test_collecting_drops_duplicates_and_stops(spark):
    rows = [(i, f"Acme{i % 3} Investments", f"https://acme{i % 3}.example/", "Texas investors") for i in range(9)] + [(20, "Jobs", "https://indeed.com", "")]
    judged = web_hits.assess(spark.createDataFrame(rows, "id long, title string, url string, snippet string"), **PLAN)
    kept, dropped = web_hits.collect(judged, 2)
    assert [r["id"] for r in kept.collect()] == [0, 1] and {(r["reason"], r["n"]) for r in dropped.collect()} == {("DUPLICATE", 6), ("JOB_BOARD", 1)}


def test_profiles_of_a_company(spark):
    rows = [
        (1, "Acme Homes", "Acme Homes | LinkedIn", "https://www.linkedin.com/company/acme?x=1", "", 1), (1, "Acme Homes", "Acme Homes - again", "https://linkedin.com/company/acme", "", 2), (1, "Acme Homes", "Acme Homes", "https://linkedin.com/in/ann", "", 3),
        (1, "Acme Homes", "Acme Foods - page", "https://facebook.com/acmefoods", "not Acme Homes", 4), (1, "Acme Homes", "Acme Homes", "https://facebook.com/sharer", "", 5), (1, "Acme Homes", "Nobody", "https://facebook.com/x", "", 6),
    ]
    found = web_hits.company_profiles(spark.createDataFrame(rows, "id int, company string, title string, url string, snippet string, n int"), ["id"]).collect()
    assert [(r["url"], r["n"]) for r in found] == [("https://linkedin.com/company/acme", 1)]


def test_investors_and_specializations(spark):
    row = spark.createDataFrame([("Oak Holdings", "We buy houses for cash")], "name string, text string")
    allowed = web_hits.investor_allowed(F.col("name"), F.lit("office"))
    refused = web_hits.investor_allowed(F.lit("Oak Realty Investments"), F.lit(None).cast("string"))
    special = [web_hits.specialization(F.col("text"), F.lit(None).cast("string"), kinds, F.lit(False)) for kinds in (["cash_home_buyer"], ["wholesaler"], ["software"])]
    assert tuple(row.select(allowed, refused, *special).first()) == (True, False, "MATCH", "NEEDS_REVIEW", "MATCH")
