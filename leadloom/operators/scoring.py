"""Deterministic lead scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import score_band

#: Points of a signal; half of them, rounded up, if only supported, and as many off if in conflict.
POINTS = {
    "companyName": 10, "website": 8, "state": 7, "fullName": 8, "title": 5, "linkedin": 4, "email": 4, "phone": 2, "companySize": 2,
    "investmentStrategy": 2, "marketsServed": 1, "propertyTypes": 1,
}
#: Fields that count for a contact, and for investors only.
CONTACT_FIELDS, INVESTOR_FIELDS = ("fullName", "title", "linkedin", "email", "phone"), ("investmentStrategy", "marketsServed", "propertyTypes")
#: Fixed values.
CLASSIFICATION, LIMITED, ACQUISITION, FRESHNESS, DIVERSITY, CONFLICT_PENALTY = 25, 5, 15, 3, 3, 10
BAD = ("CONFLICT", "NEEDS_REVIEW", "INVALID")
ACQUISITION_TEXT = r"(?i)buy|purchase|acqui|invest|cash home|fix.and.flip|rental"


def status_points(status: Column, most: int) -> Column:
    half = -(-most // 2)
    return F.when(status == "VERIFIED", most).when(status == "SUPPORTED", half).when(status.isin(*BAD), -half).otherwise(0)


def freshness(newest: Column, as_of: Column) -> Column:
    """3 points up to 30 days, 2 up to 180, 1 beyond, none without evidence."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(newest.cast("timestamp"))) / 86400e6)
    return F.when(newest.isNull(), 0).when(days <= 30, FRESHNESS).when(days <= 180, 2).otherwise(1)


def lead_scores(leads: DataFrame, fields: DataFrame, evidence: DataFrame, as_of: Column, investor: bool = False) -> DataFrame:
    """A score and band for each lead (company_id, decision, has_contact).

    `fields` has one status for each company's field; `evidence` has evidence_type, evidence_text and
    retrieved_at. Both are brought to a row per company before they are joined.
    """
    wanted = [f for f in POINTS if investor or f not in INVESTOR_FIELDS]
    pivoted = fields.groupBy("company_id").agg(
        *(F.max(F.when(F.col("field") == f, F.col("status"))).alias(f"s_{f}") for f in wanted),
        F.count_if(F.col("status").isin(*BAD)).alias("conflicts"),
    )
    gathered = evidence.groupBy("company_id").agg(F.max("retrieved_at").alias("newest"), F.countDistinct("evidence_type").alias("kinds"), F.bool_or(F.col("evidence_text").rlike(ACQUISITION_TEXT)).alias("acquires"))
    joined = leads.join(pivoted, "company_id", "left").join(gathered, "company_id", "left")
    decision = F.col("decision")
    total = F.when(decision == "QUALIFIED", CLASSIFICATION).when(decision == "NOT_QUALIFIED", -CLASSIFICATION).when(decision == "INSUFFICIENT_EVIDENCE", LIMITED).otherwise(0)
    for f in wanted:
        points = status_points(F.col(f"s_{f}"), POINTS[f])
        total += F.when(F.col("has_contact"), points).otherwise(0) if f in CONTACT_FIELDS else points
    if investor:
        total += F.when(F.col("acquires"), ACQUISITION).otherwise(0)
    total += freshness(F.col("newest"), as_of) + F.least(F.lit(DIVERSITY), F.coalesce("kinds", F.lit(0)))
    total -= F.when(F.col("conflicts") > 0, CONFLICT_PENALTY).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("long")
    return joined.select("company_id", score.alias("score"), score_band(score).alias("band"), F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


#: The name under which a field's points are reported, in order, and the column whose value is reported with them.
SIGNALS = {
    "companyName": ("company_identity", None), "website": ("official_website", None), "state": ("location", None), "fullName": ("decision_maker", "full_name"), "title": ("decision_maker_title", "title"), "linkedin": ("professional_profile", "linkedin_url"),
    "email": ("business_email", "contact_email"), "phone": ("business_phone", "contact_phone"), "companySize": ("company_size", "size"), "investmentStrategy": ("investment_strategy", "investment_strategy"), "marketsServed": ("markets_served", "has_markets"), "propertyTypes": ("property_type", "has_property_types"),
}
#: Fields that count for completeness, for companies and for investors.
COMPLETE = {
    "company": ("name", "website", "description", "phone", "size", "full_name", "contact_email", "linkedin_url"),
    "investor": ("name", "website", "description", "phone", "size", "investment_strategy", "full_name", "title", "contact_email", "contact_phone", "linkedin_url"),
}
GOOD = ("VERIFIED", "SUPPORTED")


def breakdowns(leads: DataFrame, fields: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """company_id, score, band, signals, available_fields, expected_fields, completeness, verified and conflicts of each lead, each by the mode of its own plan.

    `leads` has company_id, decision, mode (investor or company), has_contact and the columns that SIGNALS and COMPLETE name. `fields` has
    company_id, field, status, evidence_id and rank: of several rows on a field the first by rank counts. `evidence` has company_id, evidence_type,
    evidence_text and retrieved_at. verified and conflicts list field:status, each once. Signals are structs of name, value, points.
    """
    firsts = fields.groupBy("company_id", "field").agg(F.min_by("status", "rank").alias("status"), F.count_if(F.col("status").isin(*BAD)).alias("bad"), F.collect_set(F.when(F.col("status").isin(*GOOD, *BAD), F.concat_ws(":", "field", "status"))).alias("said"))
    pivoted = firsts.groupBy("company_id").agg(
        *(F.max(F.when(F.col("field") == f, F.col("status"))).alias(f"s_{f}") for f in POINTS), F.sum("bad").alias("bad"), F.array_sort(F.flatten(F.collect_list("said"))).alias("said"),
    )
    gathered = evidence.groupBy("company_id").agg(F.max("retrieved_at").alias("newest"), F.countDistinct("evidence_type").alias("kinds"), F.bool_or(F.col("evidence_text").rlike(ACQUISITION_TEXT)).alias("acquires"))
    df = leads.join(pivoted, "company_id", "left").join(gathered, "company_id", "left")
    investor, contact = F.col("mode") == "investor", F.col("has_contact")
    signal = lambda name, value, points: F.struct(name.alias("name"), F.coalesce(value.cast("string"), F.lit("NOT_FOUND")).alias("value"), points.cast("int").alias("points"))
    decision, bad, kinds = F.col("decision"), F.coalesce("bad", F.lit(0)), F.coalesce("kinds", F.lit(0))
    decided = F.when(decision == "QUALIFIED", CLASSIFICATION).when(decision == "NOT_QUALIFIED", -CLASSIFICATION).when(decision == "INSUFFICIENT_EVIDENCE", LIMITED).otherwise(0)
    known = decision.isin("QUALIFIED", "NOT_QUALIFIED", "INSUFFICIENT_EVIDENCE")
    parts = [
        signal(F.when(investor, "investor_classification").otherwise("category_classification"), F.when(known, decision).otherwise("NOT_AVAILABLE"), decided),
        F.when(investor, signal(F.lit("acquisition_evidence"), F.coalesce("acquires", F.lit(False)), F.when(F.col("acquires"), ACQUISITION).otherwise(0))),
    ]
    for field, most in POINTS.items():
        name, column = SIGNALS[field]
        one = signal(F.lit(name), F.col(f"s_{field}") if column is None else F.col(column), status_points(F.col(f"s_{field}"), most))
        parts.append(F.when(contact, one) if field in CONTACT_FIELDS else F.when(investor, one) if field in INVESTOR_FIELDS else one)
        if field == "state":
            parts.append(F.when(~contact, signal(F.lit("decision_maker"), F.lit(False), F.lit(0))))
    days = F.round(F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(F.col("newest").cast("timestamp"))) / 86400e6)).cast("long")
    parts += [
        signal(F.lit("evidence_freshness"), F.coalesce(days.cast("string"), F.lit("NOT_AVAILABLE")), freshness(F.col("newest"), as_of)), signal(F.lit("source_diversity"), kinds, F.least(F.lit(DIVERSITY), kinds)),
        signal(F.lit("conflicting_evidence"), bad, F.when(bad > 0, -CONFLICT_PENALTY).otherwise(0)),
    ]
    filled = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
    counts = {mode: sum((filled(c) for c in names), F.lit(0)) for mode, names in COMPLETE.items()}
    available = F.when(investor, counts["investor"]).otherwise(counts["company"])
    expected = F.when(investor, len(COMPLETE["investor"])).otherwise(len(COMPLETE["company"]))
    df = df.withColumns({"signals": F.filter(F.array(*parts), lambda x: x.isNotNull()), "available_fields": available, "expected_fields": expected})
    total = F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate("signals", F.lit(0), lambda a, x: a + x["points"])))
    listed = lambda statuses: F.filter(F.coalesce("said", F.array().cast("array<string>")), lambda x: F.substring_index(x, ":", -1).isin(*statuses))
    return df.select(
        "company_id", total.alias("score"), score_band(total).alias("band"), "signals", "available_fields", "expected_fields", F.floor(F.col("available_fields") * 100 / F.col("expected_fields") + 0.5).cast("int").alias("completeness"),
        listed(GOOD).alias("verified"), listed(BAD).alias("conflicts"),
    )
