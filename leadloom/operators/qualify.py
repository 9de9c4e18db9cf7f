"""Rule-based qualification: criteria as one array column, then a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import size
from leadloom.functions.text import is_generic_mailbox, title_role
from leadloom.plans.search_plan import SearchPlan


def criterion(name: str, code: Column, required: bool = True) -> Column:
    return F.struct(F.lit(name).alias("name"), code.alias("code"), F.lit(required).alias("required"))


def _status_code(status: Column) -> Column:
    return F.when(status.isin("VERIFIED", "SUPPORTED"), "MATCH").when(status.isin("CONFLICT", "NEEDS_REVIEW"), "NEEDS_REVIEW").otherwise("NOT_FOUND")


def qualify(leads: DataFrame, plan: SearchPlan, min_score: int | None = None) -> DataFrame:
    """The leads with `criteria` and `status`.

    A required NO_MATCH disqualifies; any other required code but MATCH needs review; a low score needs
    review only where all else passes.
    """
    rows = [
        criterion("identity", F.when(F.trim("name") != "", "MATCH").otherwise("NOT_FOUND")),
        criterion("website", _status_code(F.col("website_status"))),
    ]
    if plan.states:
        rows.append(criterion("location", F.when(F.coalesce(F.trim("state"), F.lit("")) == "", "NOT_FOUND").when(F.lower(F.trim("state")).isin(*(s.lower() for s in plan.states)), "MATCH").otherwise("NO_MATCH")))
    if plan.size_min is not None or plan.size_max is not None:
        fit = size.fit(F.col("employee_count"), F.col("employee_range"), plan.size_min, plan.size_max)
        rows.append(criterion("size", F.when(fit == "MATCHED", "MATCH").when(fit == "OUTSIDE_RANGE", "NO_MATCH").otherwise("NOT_FOUND")))
    rows.append(criterion("conflicts", F.when(F.coalesce("conflict", F.lit(False)), "NEEDS_REVIEW").otherwise("MATCH")))
    out = leads.withColumn("criteria", F.array(*rows))
    has = lambda test: F.exists("criteria", lambda c: c["required"] & test(c["code"]))
    low = F.lit(False) if min_score is None else F.coalesce(F.col("score"), F.lit(0)) < min_score
    status = F.when(has(lambda c: c == "NO_MATCH"), "NOT_QUALIFIED").when(has(lambda c: c != "MATCH") | low, "NEEDS_REVIEW").otherwise("QUALIFIED")
    return out.withColumn("status", status)


#: Fields whose value must be verified, or supported, where verification is asked for; names of a site's person pages.
CHECKED_FIELDS = ("email", "phone", "linkedin", "facebook", "instagram", "youtube", "website")
COMPANY_PAGE, PERSON_PAGE = r"(?i)linkedin\.com/(company|school)/", r"(?i)linkedin\.com/in/"


def field_criterion(field: str, value: Column, status: Column, person: bool, required: bool, check: bool, owned: Column | None = None) -> Column:
    """The code of a criterion on one field of a company or of a person.

    A shared mailbox is no person's address, and a company's page no person's profile. With `check` a person's address
    must be known to be the person's own (`owned`), any other checked field to be verified or supported.
    """
    code = F.when(F.coalesce(value, F.lit("")) == "", "NOT_FOUND")
    if person and field == "email":
        code = code.when(is_generic_mailbox(value), "NOT_FOUND")
    if person and field == "linkedin":
        code = code.when(value.rlike(COMPANY_PAGE), "NOT_FOUND")
    code = code.when(status == "INVALID", "NO_MATCH").when(status.isin("CONFLICT", "NEEDS_REVIEW"), "NEEDS_REVIEW")
    if person and field == "email" and check:
        code = code.when(~F.coalesce(F.lit(False) if owned is None else owned, F.lit(False)), "NEEDS_REVIEW")
    elif required and check and field in CHECKED_FIELDS:
        code = code.when(~F.coalesce(status.isin("VERIFIED", "SUPPORTED"), F.lit(False)), "NEEDS_REVIEW")
    return code.otherwise("MATCH")


def contact_criterion(field: str, person_value: Column, company_value: Column, status: Column, person_only: bool, required: bool, check: bool, owned: Column) -> Column:
    """The code of a criterion on a contact's field; a company's value stands in for an e-mail address or a phone number unless a person's is asked for."""
    only = person_only and field == "email"
    value = person_value if only or field not in ("email", "phone") else F.coalesce(person_value, company_value)
    code = F.when(F.coalesce(value, F.lit("")) == "", "NOT_FOUND")
    if only:
        code = code.when(is_generic_mailbox(value), "NOT_FOUND")
    code = code.when(status.isin("CONFLICT", "NEEDS_REVIEW"), "NEEDS_REVIEW")
    if only and check:
        code = code.when(~F.coalesce(owned, F.lit(False)), "NEEDS_REVIEW")
    elif (required or check) and field in ("email", "phone"):
        code = code.when(~F.coalesce(status.isin("VERIFIED", "SUPPORTED"), F.lit(False)), "NEEDS_REVIEW")
    return code.otherwise("MATCH")


def social_criterion(platform: str, profiles: Column) -> Column:
    """The code of a criterion on a company's profile; `profiles` is array<struct<platform, url>>, and a person's page is none of a company."""
    names = ("x", "twitter") if platform.lower() == "x" else (platform.lower(),)
    url = F.get(F.filter(profiles, lambda p: F.lower(p["platform"]).isin(*names) & (F.coalesce(p["url"], F.lit("")) != "")), 0)["url"]
    personal = url.rlike(PERSON_PAGE) if platform.lower() == "linkedin" else F.lit(False)
    return F.when(url.isNull() | personal, "NOT_FOUND").otherwise("MATCH")


def verification_criterion(value: Column, status: Column) -> Column:
    """The code of a criterion that a field be verified: what is not verified or supported needs review."""
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "NOT_FOUND").when(status == "INVALID", "NO_MATCH").when(F.coalesce(status.isin("VERIFIED", "SUPPORTED"), F.lit(False)), "MATCH").otherwise("NEEDS_REVIEW")
    )


def has_role(title: Column, normalized: Column, roles: list[str]) -> Column:
    """Whether a title, or a role made of it, is one of the wanted roles."""
    wanted = F.array(*(title_role(F.lit(r)) for r in roles))
    return F.coalesce(F.array_contains(wanted, title_role(title)), F.lit(False)) | F.coalesce(F.array_contains(wanted, title_role(normalized)), F.lit(False))


def preferred_contacts(contacts: DataFrame, roles: list[str]) -> DataFrame:
    """For each company its first contact in order of n with a wanted role, else its first contact, as `contact`."""
    value = F.struct(*(c for c in contacts.columns if c != "company_id"))
    matched = has_role(F.col("title"), F.col("normalized_role"), roles) if roles else F.lit(False)
    return contacts.groupBy("company_id").agg(F.min_by(value, F.struct((~matched).alias("m"), "n")).alias("contact"), F.bool_or(matched).alias("role_found"), F.bool_or(F.trim(F.coalesce("full_name", F.lit(""))) != "").alias("named"))


def decision_maker_criterion(named: Column, role_found: Column, full_name: Column, title: Column, verdict: Column, statuses: list[Column]) -> Column:
    """The code of the criterion on a decision maker: a wanted role, a first and a last name, a tie to the company, and no conflict."""
    two = F.size(F.filter(F.split(F.trim(full_name), r"\s+"), lambda p: p != "")) >= 2
    open_ = F.lit(False)
    for s in statuses:
        open_ |= F.coalesce(s.isin("CONFLICT", "NEEDS_REVIEW"), F.lit(False))
    return (
        F.when(~F.coalesce(named, F.lit(False)), "NOT_FOUND").when(~role_found, "NO_MATCH").when((F.trim(F.coalesce(title, F.lit(""))) == "") | ~two, "NEEDS_REVIEW").when(verdict == "REJECTED", "NO_MATCH")
        .when(F.coalesce(verdict, F.lit("MISSING")).isin("MISSING", "WEAK", "AMBIGUOUS"), "NEEDS_REVIEW").when(open_, "NEEDS_REVIEW").otherwise("MATCH")
    )


def kept_for_review(status: Column, from_model: Column, name: Column, reachable: Column) -> Column:
    """A disqualified company that a model found, and that has a name and a site or a profile, is kept for review."""
    return F.when((status == "NOT_QUALIFIED") & from_model & (F.trim(F.coalesce(name, F.lit(""))) != "") & reachable, "NEEDS_REVIEW").otherwise(status)


def reason_text(criteria: Column) -> Column:
    """Three lists of criteria, those that match, that fail and that need review, in one line."""
    part = lambda label, codes: F.when(F.exists(criteria, lambda c: c["code"].isin(*codes)), F.concat(F.lit(f"{label}: "), F.array_join(F.transform(F.filter(criteria, lambda c: c["code"].isin(*codes)), lambda c: c["name"]), ", ")))
    return F.concat_ws("; ", part("qualified", ["MATCH"]), part("disqualified", ["NO_MATCH"]), part("needs review", ["NEEDS_REVIEW", "NOT_FOUND"]))
