"""What prompts ask for, and drafts of plans held against them."""

import pytest

from leadloom.operators.prompts import parse

TEXAS, NONE = [("US", "Texas", None)], []

#: A prompt, and the parts of its plan that must be so.
CASES = [
    ("Find real estate companies in TX that are cash home buyers with 1–50 employees. Need website, LinkedIn, Facebook and Instagram, plus the CEO, founder or president with email.",
     dict(industry=["real_estate"], lead_types=["cash_home_buyer"], places=TEXAS, size=(1, 50), company_fields=["website", "linkedin", "facebook", "instagram"], roles=["CEO", "Founder", "President"], contact_fields=["email", "linkedin", "facebook", "instagram"])),
    ("Find real estate investors actively buying distressed properties in Texas.", dict(unresolved=[("actively buying distressed properties", "requires evidence-based source classification")])),
    ("Find cash home buyers in Texas with company size 1-50 and identify their CEO, founder, president, or owner.", dict(lead_types=["cash_home_buyer"], places=TEXAS, size=(1, 50), roles=["CEO", "Founder", "President", "Owner"])),
    ("Find up to 50 real estate investment companies in Texas with company size 1-50 employees", dict(industry=["real_estate"], lead_types=["real_estate_investor"], places=TEXAS, size=(1, 50), max_results=50, roles=[])),
    *((p, dict(industry=["real_estate"], lead_types=["real_estate_investor"], places=TEXAS)) for p in (
        "Find real estate investors in Texas", "Find real-estate investors in Texas", "Find real estate investment companies in Texas", "Find real-estate investment companies in Texas",
        "Find up to 50 real-estate investment companies in Texas with company size 1-50 employees")),
    ("Find real-estate agents in Texas", dict(industry=["real_estate"], lead_types=[])),
    *((f"Find up to 500 {p} firms in Texas with company size 1-50 employees.", dict(industry=["real_estate"], lead_types=["real_estate_investor"], places=TEXAS, size=(1, 50), max_results=500)) for p in (
        "real estate investment", "real-estate investment", "real estate investor", "real-estate investor", "property investor", "real estate investment company")),
    ("Find up to 500 investment company firms in Texas with company size 1-50 employees.", dict(industry=["investment"], lead_types=[], places=TEXAS, size=(1, 50), requested_count=500)),
    ("Find 50 real estate investment companies in Texas", dict(requested_count=50, count_intent="exact", industry=["real_estate"], lead_types=["real_estate_investor"], places=TEXAS, size=None)),
    ("Find 300 software companies in California", dict(requested_count=300, max_results=300, industry=["software"], lead_types=[], places=[("US", "California", None)], size=None)),
    ("Find 100 marketing agencies in New York", dict(requested_count=100, industry=["marketing"], places=[("US", "New York", None)])),
    ("Find 200 SaaS companies in Germany", dict(requested_count=200, industry=["saas"], places=[("Germany", None, None)])),
    ("Find 75 restaurants in Dubai", dict(requested_count=75, industry=["restaurant"], places=[("United Arab Emirates", None, "Dubai")])),
    ("Find 50 companies in Lahore", dict(requested_count=50, industry=[], places=[("Pakistan", None, "Lahore")])),
    ("Find up to 500 companies", dict(requested_count=500, count_intent="maximum", industry=[], places=NONE)),
    ("Find 50 companies", dict(requested_count=50, industry=[], lead_types=[], places=NONE)),
    ("Find at least 100 companies", dict(requested_count=100, count_intent="minimum")),
    ("Find maximum 300 companies", dict(requested_count=300, count_intent="maximum")),
    ("Find 5000 companies", dict(requested_count=5000, max_results=1000, unresolved=[("5000", "requested count was limited to the safety cap of 1000")])),
    ("Find 150 construction companies in Florida with 10-100 employees", dict(requested_count=150, industry=["construction"], places=[("US", "Florida", None)], size=(10, 100))),
    ("Find 300 leads without specifying company size", dict(requested_count=300, size=None, industry=[], places=NONE, exclusions=[])),
    ("Find 200 qualified leads without specifying employee size", dict(requested_count=200, target_type="QUALIFIED_LEADS", size=None)),
    ("Find around 200 logistics companies in Toronto", dict(requested_count=200, count_intent="approximate", industry=["logistic"], places=[("Canada", "Ontario", "Toronto")])),
    ("Find small companies", dict(size=None, qualitative_size="small", unresolved=[("small", "qualitative employee size was requested without a numeric range")])),
    ("Find companies near London", dict(places=[("United Kingdom", None, "London")], unresolved=[("near London", "no search radius was specified")])),
    ("Find companies with verified email", dict(email=(True, True, True))),
    ("Find companies with email", dict(email=(True, False, False))),
    ("Find companies with LinkedIn and Facebook", dict(social_platforms=["linkedin", "facebook"], person_fields=[], required=["companyLinkedin", "companyFacebook"])),
    ("Find companies and I need their LinkedIn", dict(person_fields=["linkedin"], required=["personLinkedin"])),
    ("Find consulting firms and identify the partner or managing director", dict(has_roles=["Partner", "Managing Director"])),
    ("Find 50 companies in Bavaria", dict(places=[("", None, "Bavaria")], unresolved=[("Bavaria", "location could not be confidently resolved to a country or administrative area")])),
    ("Find 20 bakeries in Bavaria", dict(requested_count=20, industry=["bakery"], lead_types=[])),
    ("Find excellent businesses with strong reputations.", dict(industry=[], lead_types=[], unresolved=[("Find excellent businesses with strong reputations.", "no supported deterministic search criteria were recognized")])),
    ("Find 10 software companies in California with social profiles", dict(social_platforms=["linkedin", "facebook", "instagram", "x", "youtube"], industry=["software"], places=[("US", "California", None)])),
    ("Find 10 software companies in California with verified decision-maker emails", dict(email=(True, True, True), person_fields=["email"], verified=["email"])),
    ("Find 10 real estate investment companies in Texas with founders or CEOs and verified emails", dict(lead_types=["real_estate_investor"], has_roles=["Founder", "CEO"], email=(True, True, True))),
    ("Find 300 Real Estate Investment companies in Texas (Cash Home Buyers, Fix & Flip, Wholesalers) with 1-50 employees including Decision Maker Details, Address, Phone, and Social Profiles. Emails do NOT need to be verified.",
     dict(requested_count=300, lead_types=["cash_home_buyer", "fix_and_flip", "wholesaler", "real_estate_investor"], verification=(False, False, []), email=(True, False, False))),
    # Beyond the reference's cases: places joined by and, a place's parts, a size that is no count, exclusions, a score, a lone country, the last preposition.
    ("Find software firms in Austin, TX and Berlin and the United Kingdom excluding banks, minimum score 70", dict(places=[("US", "Texas", "Austin"), ("Germany", None, "Berlin"), ("United Kingdom", None, None)], exclusions=["banks"], minimum_score=70)),
    ("Find software companies with 25 employees", dict(requested_count=None, size=(25, 25))),
    ("Find software companies with 10+ employees", dict(size=(10, None))),
    ("We need software vendors across the USA", dict(places=[("US", None, None)])),
    ("Find dealers in stock that are near Texas with a website", dict(places=TEXAS, required=["website"])),
    ("  ", dict(industry=[], places=NONE, requested_count=None, unresolved=[("", "no supported deterministic search criteria were recognized")])),
    (None, dict(industry=[], places=NONE, original_prompt="")),
]


@pytest.fixture(scope="module")
def plans(spark):
    rows = spark.createDataFrame([(i, p, "own") for i, (p, _) in enumerate(CASES)], "id int, prompt string, plan string")
    return {r["id"]: r["plan"] for r in parse(rows).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_prompt(plans, i):
    plan = plans[i]
    for key, wanted in CASES[i][1].items():
        if key == "places":
            assert [(p["country"], p["state"], p["city"]) for p in plan["locations"]] == wanted
        elif key == "size":
            size = plan["company_size"]
            assert (size and (size["min"], size["max"])) == wanted
        elif key == "unresolved":
            assert set(wanted) <= {tuple(u) for u in plan["unresolved"]}
        elif key in ("email", "verification"):
            assert tuple(plan[key]) == wanted
        elif key == "required":
            assert set(wanted) <= set(plan["required_fields"])
        elif key == "has_roles":
            assert set(wanted) <= set(plan["roles"])
        elif key == "verified":
            assert set(wanted) <= set(plan["verification"]["fields"])
        else:
            assert plan[key] == wanted, key
