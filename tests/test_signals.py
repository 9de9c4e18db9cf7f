"""Contact quality, ties to companies, own sites and sizes: cases, and plain Python versions of the rules."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadloom.functions import size
from leadloom.operators import contact_quality, discovery, signals, websites

NOW = datetime(2024, 6, 1)


def plain_host(url):
    m = re.match(r"[a-z]+://([^/?#]+)", url or "")
    return re.sub(r"^www\.", "", m[1].lower()) if m else None


def plain_quality(c, evidence, roles, days):
    """The rules of contact quality for one contact, straight."""
    person = " ".join(c["full_name"].lower().split())
    named = lambda e: person in e["excerpt"].lower()
    linked = lambda e: named(e) and (c["company"].lower() in f"{e['excerpt']} {e['value']}".lower() or (plain_host(e["source_url"]) is not None and plain_host(e["source_url"]) == plain_host(c["website"])))
    digits = lambda x: re.sub("[^0-9]", "", x or "")
    phone = lambda x: (("+" if x.strip().startswith("+") else "") + digits(x)) if digits(x) else None

    def sources(items):
        keys = set()
        for e in items:
            text = " ".join(e["excerpt"].lower().split())
            h = plain_host(e["source_url"])
            keys.add("copy" + text if len(text) >= 80 else ".".join(h.split(".")[-2:]) if h else "type" + e["source_type"])
        return len(keys)

    def held(t):
        t = " ".join(re.sub("[_-]", " ", t).split()).lower()
        return re.sub(r"^(former|ex|previous)\s+", "", t), bool(re.match(r"(former|ex|previous)\b", t))

    def recent(status, items):
        at = max((e["retrieved_at"] for e in items), default=None)
        return "SUPPORTED" if status == "VERIFIED" and at and (NOW - at).total_seconds() / 86400 > days else status

    level = lambda items: "VERIFIED" if sources(items) >= 2 else "SUPPORTED"
    ties = [e for e in evidence if linked(e)]
    out = {}
    about = [e for e in evidence if named(e)]
    out["name"] = recent(level(about), about) if about and ties else "UNVERIFIED"
    out["relationship"] = recent(level(ties), ties) if ties else "UNVERIFIED"
    claims = [e for e in evidence if e["field"] in ("title", "normalizedRole")]
    now, before = {}, {}
    for e in sorted(claims, key=lambda e: e["id"]):
        norm, old = held(e["value"])
        (before if old else now).setdefault(norm, e)
    conflicts = int(len(now) > 1 or (len(now) == 1 and len(before) == 1 and list(now) != list(before)))
    picked = list(now.values()) or list(before.values())
    norm, old = held(picked[0]["value"] if picked else c["title"] or "")
    same = [e for e in claims if held(e["value"]) == (norm, old)]
    out["title"] = "CONFLICT" if conflicts else ("UNVERIFIED" if c["title"] else "NOT_FOUND") if not picked else "UNVERIFIED" if not ties else "SUPPORTED" if old else recent(level(same), same)
    role = None if conflicts or old or not ties else next((r for r in roles if held(r)[0] == norm), None)
    mails = [e for e in evidence if e["field"] == "email" and e["value"].strip()]
    several = len({e["value"].strip().lower() for e in mails}) > 1
    conflicts += several
    address = (c["email"] if c["email"] is not None else min(mails, key=lambda e: e["id"])["value"] if mails else "").strip().lower()
    own = [e for e in mails if e["value"].strip().lower() == address and named(e)]
    out["email"] = "CONFLICT" if several else "NOT_FOUND" if not mails else "UNVERIFIED" if not own else recent(level(own) if ties else "SUPPORTED", own)
    calls = [e for e in evidence if e["field"] == "phone" and phone(e["value"])]
    several = len({phone(e["value"]) for e in calls}) > 1
    conflicts += several
    number = phone(c["phone"] or "") or (phone(min(calls, key=lambda e: e["id"])["value"]) if calls else None)
    mine = [e for e in calls if any(digits(number) in digits(s) and person in s.lower() for s in re.split(r"[.\n]", e["excerpt"]))]
    switchboard = number is not None and number == phone(c["company_phone"] or "")
    out["phone"] = "CONFLICT" if several else "NOT_FOUND" if not calls else "UNVERIFIED" if not mine or switchboard else recent(level(mine) if ties else "SUPPORTED", mine)
    for p, hosts in contact_quality.PLATFORMS.items():
        url = c[f"{p}_url"]
        shown = [e for e in ties if e["field"] in (p, p + "Url") or (e["field"] == "profileUrl" and plain_host(e["value"]) in hosts)]
        out[p] = "NOT_FOUND" if not (url or "").strip() else "UNVERIFIED" if plain_host(url) not in hosts or not shown else recent(level(shown), shown)
    points = sum({"VERIFIED": a, "SUPPORTED": b, "CONFLICT": -b}.get(out[k], 0) for k, (a, b) in {"name": (20, 10), "relationship": (15, 8), "title": (20, 10), "email": (15, 8)}.items())
    social = [out[p] for p in contact_quality.PLATFORMS]
    points += 10 if "VERIFIED" in social else 5 if "SUPPORTED" in social else 0
    points += min(10, 5 * sources(evidence)) + (0 if not evidence else 10 if (NOW - max(e["retrieved_at"] for e in evidence)).total_seconds() / 86400 <= days else 4) - 10 * (conflicts > 0)
    return {**out, "role": role, "conflicts": conflicts, "score": max(0, min(100, points))}


def test_contact_quality_equals_the_plain_rules(spark):
    rng = random.Random(12)
    contacts, evidence = [], []
    for i in range(60):
        contacts.append({
            "id": i, "full_name": f"Ann  Person{i}", "title": rng.choice(["CEO", None, "former CEO"]), "email": rng.choice([None, f"p{i}@co.example"]), "phone": rng.choice([None, "+1 555 010-0000"]), "linkedin_url": rng.choice([None, f"https://www.linkedin.com/in/p{i}", "https://x.example"]),
            "facebook_url": None, "instagram_url": " ", "youtube_url": rng.choice([None, "https://youtu.be/x"]), "company": f"Acme {i}", "website": rng.choice([None, f"https://www.acme{i}.example"]), "company_phone": rng.choice([None, "+15550100000"]),
        })
        for k in range(rng.randint(0, 6)):
            field = rng.choice(["title", "normalizedRole", "email", "phone", "linkedin", "profileUrl", "youtubeUrl", "other"])
            value = {"title": rng.choice(["CEO", "Owner", "Former CEO", "ex-owner"]), "normalizedRole": "ceo", "email": rng.choice([f"P{i}@co.example", f"p{i}@co.example", "q@co.example", " "]), "phone": rng.choice(["+1 (555) 010-0000", "12345678", "none"])}.get(field, rng.choice(["https://linkedin.com/in/p", "v"]))
            excerpt = rng.choice([f"Ann Person{i} of Acme {i}, call 1 555 010 0000.", f"ann person{i} was here", "nobody", f"Ann Person{i} leads Acme {i}. " + "The same long line again and again. " * 3])
            evidence.append({"contact_id": i, "id": 100 * i + k, "field": field, "value": value, "source_type": rng.choice(["a", "b"]), "source_url": rng.choice([None, f"https://acme{i}.example/team", "https://www.news.example/x", "https://b.news.example"]), "excerpt": excerpt, "retrieved_at": NOW - timedelta(days=rng.choice([1, 50, 400]))})
    c = spark.createDataFrame(contacts, "id long, full_name string, title string, email string, phone string, linkedin_url string, facebook_url string, instagram_url string, youtube_url string, company string, website string, company_phone string")
    e = spark.createDataFrame(evidence, "contact_id long, id long, field string, value string, source_type string, source_url string, excerpt string, retrieved_at timestamp")
    got = contact_quality.contact_quality(c, e, ["CEO", "Owner"], 90, F.lit("2024-06-01").cast("timestamp")).collect()
    for row in got:
        want = plain_quality(contacts[row["id"]], [x for x in evidence if x["contact_id"] == row["id"]], ["CEO", "Owner"], 90)
        shown = {k: row[f"{k}_status"] for k in ("name", "relationship", "title", "email", "phone", *contact_quality.PLATFORMS)}
        assert {**shown, "role": row["matched_role"], "conflicts": row["conflicts"], "score": row["quality_score"]} == want
    assert len(got) == 60


# Cases with the outcomes that must match.
@pytest.mark.parametrize(
    "text, relation, status, verdict",
    [
        ([("Ada Byron, CEO of Northwind Homes", "https://northwind.example/team")], None, None, "STRONG"), ([("Ada Byron is the CEO at Northwind Homes", "https://www.linkedin.com/in/ada")], None, None, "SUPPORTED"),
        ([("Ada Byron, CEO of Southgale Foods", "https://news.example/a")], None, None, "REJECTED"), ([("Ada Byron and Northwind Homes met", "https://news.example/a")], None, None, "AMBIGUOUS"), ([("Somebody else", "https://news.example")], "current", None, "WEAK"),
        ([], None, "VERIFIED", "STRONG"), ([], None, None, "MISSING"), ([("Ada Byron (CEO) of Northwind Homes+Co", None)], None, None, "AMBIGUOUS"),
    ],
)
def test_relationships(spark, text, relation, status, verdict):
    people = spark.createDataFrame([(1, "Ada Byron", "CEO", "Northwind Homes", "https://northwind.example", relation, status)], "id int, person string, title string, company string, website string, relation string, relation_status string")
    evidence = spark.createDataFrame([(1, k, t, u) for k, (t, u) in enumerate(text)], "id int, n long, text string, url string")
    assert signals.relationships(people, evidence).first()["verdict"] == verdict


@pytest.mark.parametrize(
    "row, reason, score",
    [
        (("Northwind Homes", "Austin", "Texas", "https://northwindhomes.example/", "Northwind Homes", "Call 555-010-0000 in Austin", None), "OFFICIAL_WEBSITE", 38),
        (("Northwind Homes", None, None, "https://www.yelp.com/biz/northwind", "Northwind Homes", "", None), "REVIEW_SITE", 0), (("LLC", None, None, "https://x.example", "LLC", "", None), "INSUFFICIENT_COMPANY_MATCH", 0),
        (("Northwind Homes", None, None, "https://list.example/a", "Northwind Homes - Company Profile", "business directory", None), "DIRECTORY", 0), (("Northwind Homes", None, None, "https://paper.example/news/a", "Northwind Homes", "", None), "NEWS_ARTICLE", 0),
        (("Northwind Capital", None, None, "https://northwindrealty.example", "Welcome", "Northwind is a firm", None), "DIFFERENT_COMPANY", 0), (("Northwind Homes", None, None, "https://other.example", "Northwind Homes | Daily Planet", "", None), "GENERIC_THIRD_PARTY_PAGE", 0),
        (("Northwind Homes", None, None, None, "A page", "Nothing", "<h1>Other</h1>"), "INSUFFICIENT_COMPANY_MATCH", 0),
    ],
)
def test_official_websites(spark, row, reason, score):
    pages = spark.createDataFrame([row], "company string, city string, state string, url string, title string, text string, html string")
    got = websites.official_websites(pages).first()
    assert (got["reason"], got["score"]) == (reason, score)


def test_best_website(spark):
    rows = [(1, 0, "a", False, True, 20), (1, 1, "b", False, True, 30), (1, 2, "c", False, True, 30), (2, 0, "d", False, True, 38), (2, 1, "e", True, True, 12), (3, 0, "f", False, False, 0)]
    found = websites.best_website(spark.createDataFrame(rows, "id int, n int, url string, known boolean, accepted boolean, score int"), ["id"]).collect()
    assert {(r["id"], r["url"]) for r in found} == {(1, "b"), (2, "e")}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("about 25 employees, later 30 employees", ("exact", 30, 30)), ("about 25 employees", ("unusable", None, None)), ("Employees: 12", ("exact", 12, 12)), ("roughly employees: 12", None), ("11-50 employees", ("range", 11, 50)), ("50-11 employees", None),
        ("up to 11-50 employees", ("unusable", None, None)), ("500+ employees", ("unusable", None, None)), ("a small business", ("unusable", None, None)), ("number of employees = 7", ("exact", 7, 7)), ("about number of employees 7", None), ("3.5 employees", None), ("", None), (None, None),
    ],
)
def test_sizes_of_all_matches(spark, text, expected):
    got = spark.createDataFrame([(text,)], "x string").select(size.extract(F.col("x"))).first()[0]
    assert (None if got is None else tuple(got)) == expected


@pytest.mark.parametrize("url, reason", [("https://yelp.com", "REVIEW_SITE"), ("acme.example", None), (None, None), ("https://sec.gov", "PROXY_OR_FILING"), ("https://a.example/blog/x", "GENERIC_LIST"), ("mailto:x", "INVALID_URL")])
def test_url_gate(spark, url, reason):
    assert spark.createDataFrame([(url,)], "x string").select(discovery.reject_url(F.col("x"))).first()[0] == reason
