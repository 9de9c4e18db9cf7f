"""What models wrote: classifications with their faults, and lists of companies in all forms, cut at every place."""

import json

import pytest
from pyspark.sql import functions as F

from leadloom.operators.model_output import backed, classifications, company_lists

GOOD = {
    "decision": "QUALIFIED", "confidence": 0.8, "category": "investor", "investorType": "Buy & Hold", "reasons": ["r"], "positiveEvidence": ["e1", {"evidenceId": " e2 ", "reason": "why"}, {"id": "e3"}], "negativeEvidence": [], "missingEvidence": [],
    "exclusionReason": None, "companySizeVerification": " found ", "locationStatus": None,
}
TEXT = json.dumps(GOOD)
REJECTED = [
    (None, "EMPTY_RESPONSE"), ("```json\n```", "EMPTY_RESPONSE"), ("no json here", "INVALID_JSON"), ("null", "INVALID_JSON"), ("[1, 2]", "INVALID_SCHEMA: classification"), ("5", "INVALID_SCHEMA: classification"), ('{"decision": ', "INVALID_JSON"),
    *((json.dumps(GOOD | {k: v}), e) for k, v, e in (
        ("decision", None, "MISSING_REQUIRED_FIELD: decision"), ("decision", "MAYBE", "INVALID_ENUM: decision"), ("category", "", "INVALID_SCHEMA: category"), ("category", None, "MISSING_REQUIRED_FIELD: category"), ("investorType", "DENTIST", "INVALID_ENUM: investorType"),
        ("investorType", 7, "INVALID_ENUM: investorType"), ("exclusionReason", 1, "INVALID_SCHEMA: exclusionReason"), ("confidence", "", "INVALID_SCHEMA: confidence"), ("confidence", 1.2, "INVALID_SCHEMA: confidence"), ("confidence", None, "MISSING_REQUIRED_FIELD: confidence"),
        ("confidence", [1], "INVALID_SCHEMA: confidence"), ("reasons", "r", "INVALID_SCHEMA: reasons"), ("reasons", ["a", 1], "INVALID_SCHEMA: reasons"), ("missingEvidence", None, "MISSING_REQUIRED_FIELD: missingEvidence"), ("positiveEvidence", [{"reason": "x"}], "INVALID_SCHEMA: positiveEvidence"),
        ("negativeEvidence", ["!"], "INVALID_SCHEMA: negativeEvidence"), ("locationStatus", "PERHAPS", "INVALID_SCHEMA: locationStatus"))),
]
ACCEPTED = [TEXT, f"```json\n{TEXT}\n```", f"Here it is: {TEXT} as asked.", json.dumps({"classification": GOOD}), json.dumps({"result": GOOD, "decision": 3}), json.dumps(GOOD | {"confidence": " 0.8 "})]


def test_every_text_is_accepted_or_rejected(spark):
    texts = [t for t, _ in REJECTED] + ACCEPTED
    got = {r["i"]: r for r in classifications(spark.createDataFrame(list(enumerate(texts)), "i int, content string")).collect()}
    assert [got[i]["error"] for i in range(len(texts))] == [e for _, e in REJECTED] + [None] * len(ACCEPTED)
    for i, r in got.items():
        assert (r["error"] is None) == (r["result"] is not None)
        if r["result"]:
            assert (r["result"]["decision"], r["result"]["confidence"], r["result"]["investor_type"], r["result"]["company_size_verification"], r["result"]["location_status"]) == ("QUALIFIED", 0.8, "BUY_AND_HOLD", "FOUND", "NOT_FOUND")
            assert [tuple(e) for e in r["result"]["positive_evidence"]] == [("e1", ""), ("e2", "why"), ("e3", "")]


def test_qualified_needs_known_evidence(spark):
    rows = classifications(spark.createDataFrame([(TEXT, ["e2"]), (TEXT, ["other"])], "content string, known array<string>"))
    found = [r[0] for r in rows.select(backed(F.col("result"), F.col("known"))).collect()]
    assert [(r["decision"], len(r["positive_evidence"]), r["missing_evidence"]) for r in found] == [("QUALIFIED", 1, []), ("INSUFFICIENT_EVIDENCE", 0, ["Verified evidence supporting qualification"])]


COMPANIES = [
    {"company_name": 'Oak "One" {x}', "official_website": "https://oak.example", "evidence_url": "https://dir.example/oak", "contacts": [{"full_name": "Ann B", "title": "CEO"}]},
    {"company_name": "Elm ] \\ Co", "official_website": "https://elm.example", "contacts": []},
    {"company_name": "No Site"},
    {"company_name": "Ash", "official_website": "http://ash.example/a?b=[1]"},
]


def test_text_cut_anywhere_keeps_what_was_closed(spark):
    whole = json.dumps({"companies": COMPANIES})
    ends = [whole.index(json.dumps(c)) + len(json.dumps(c)) for c in COMPANIES]
    got = company_lists(spark.createDataFrame([(n, whole[:n]) for n in range(len(whole) + 1)], "n int, content string").repartition(4)).collect()
    for r in got:
        kept = [c["company_name"] for c, end in zip(COMPANIES, ends) if end <= r["n"] and "official_website" in c]
        assert [c["company_name"] for c in r["companies"]] == kept, r["n"]
        assert r["form"] == ("json" if r["n"] == len(whole) else "partial" if kept else None)


@pytest.mark.parametrize("content, form, expected", [
    (json.dumps(COMPANIES[:2]), "json", [('Oak "One" {x}', "https://oak.example", "https://dir.example/oak"), ("Elm ] \\ Co", "https://elm.example", "https://elm.example")]),
    ('Sure! {"note": "}"} then {"results": [{"name": "Ash", "website": "https://ash.example"}]} done', "json", [("Ash", "https://ash.example", "https://ash.example")]),
    ('```json\n{"companyName": "Ash", "officialWebsite": "https://ash.example"}\n```', "json", [("Ash", "https://ash.example", "https://ash.example")]),
    ("- Oak Stream | builders\n  Website: https://oak.example.\n  Source: https://dir.example/oak\n  Contact: Ann B\n  Title: CEO\n  Email: a@oak.example\nCompany: Elm\n https://elm.example", "bullets",
     [("Oak Stream", "https://oak.example", "https://dir.example/oak"), ("Elm", "https://elm.example", "https://elm.example")]),
    ("The firm **Oak Stream** builds homes, see https://oak.example/about.\n\nAlso [Elm Realty](https://elm.example) and **Nowhere Inc**", "prose", [("Elm Realty", "https://elm.example", "https://elm.example"), ("Oak Stream", "https://oak.example/about", "https://oak.example/about"), ("Nowhere Inc", "https://elm.example", "https://elm.example")]),
    ("nothing at all", None, []), ("", None, []), (None, None, []), ("{{{{", None, []), ("]]]]}}", None, []), ('"' * 7, None, []),
])
def test_forms(spark, content, form, expected):
    (r,) = company_lists(spark.createDataFrame([(content,)], "content string")).collect()
    assert (r["form"], [(c["company_name"], c["official_website"], c["evidence_url"]) for c in r["companies"]]) == (form, expected)
