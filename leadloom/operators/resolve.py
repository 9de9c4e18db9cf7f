"""Entity resolution: pair signals, decisions, master election, survivorship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of company signals.
COMPANY_WEIGHTS = {
    "EXTERNAL_ID": 55, "PLACE_ID": 55, "DOMAIN": 55, "VERIFIED_PHONE": 55, "VERIFIED_EMAIL": 55, "PHONE": 20, "ADDRESS": 15, "SOCIAL": 25, "NAME": 10, "LOCATION": 8, "EMAIL_DOMAIN": 5,
}
#: Weights of contact signals; a name with its title holds the title's weight, which counts again by itself.
CONTACT_WEIGHTS = {"VERIFIED_EMAIL": 60, "EMAIL": 25, "PHONE": 20, "LINKEDIN": 55, "SOCIAL": 30, "NAME_TITLE_COMPANY": 55, "NAME_COMPANY": 30, "TITLE": 25}
#: Scores from which a pair is a duplicate or goes to review, and the most that a soft match gets.
AUTO, REVIEW, SOFT_MOST = 55, 30, 40


def _equal(column: str) -> Column:
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    return F.coalesce((a == b) & (a != "") if column not in ("phone_verified", "email_verified") else a & b, F.lit(False))


def _shared(column: str) -> Column:
    return F.coalesce(F.arrays_overlap(f"a.{column}", f"b.{column}"), F.lit(False))


def _decide(signals: dict[str, Column], weights: dict[str, int], hard: Column, conflict: Column, soft: Column) -> list[Column]:
    """status, match_type, confidence and the matched signals of a pair."""
    score = F.least(F.lit(100), sum((F.when(signals[k], w).otherwise(0) for k, w in weights.items()), F.lit(0)))
    strongest = F.greatest(*(F.when(signals[k], w).otherwise(0) for k, w in weights.items()))
    status = F.when(conflict, "CONFLICT").when(soft, "NEEDS_REVIEW").when((score >= AUTO) & hard, "AUTO_DUPLICATE").when(score >= REVIEW, "NEEDS_REVIEW").otherwise("PENDING")
    kind = (
        F.when(conflict, "CONFLICT").when(soft, "POTENTIAL_DUPLICATE").when((score >= AUTO) & hard, F.when(strongest >= 50, "EXACT_MATCH").otherwise("STRONG_MATCH"))
        .when(score >= REVIEW, F.when(hard, "POSSIBLE_MATCH").otherwise("POTENTIAL_DUPLICATE")).otherwise("NO_MATCH")
    )
    points = F.when(conflict, 50).when(soft, F.least(F.greatest(score, F.lit(REVIEW)), F.lit(SOFT_MOST))).otherwise(score)
    matched = F.array_compact(F.array(*(F.when(signals[k], k) for k in weights)))
    return [status.alias("status"), kind.alias("match_type"), (points / 100).cast("double").alias("confidence"), F.array_join(matched, ",").alias("signals")]


def match_companies(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """A decision for each pair (a, b) of normalised company records.

    Records have id, name, domain, phone, place_id, address, city, state, email, email_domain, social_urls,
    external_ids, phone_verified and email_verified.
    """
    joined = pairs.alias("p").join(records.alias("a"), F.col("p.a") == F.col("a.id")).join(records.alias("b"), F.col("p.b") == F.col("b.id"))
    phone, email = _equal("phone"), _equal("email")
    verified_phone, verified_email = phone & _equal("phone_verified"), email & _equal("email_verified")
    signals = {
        "EXTERNAL_ID": _shared("external_ids"), "PLACE_ID": _equal("place_id"), "DOMAIN": _equal("domain"), "VERIFIED_PHONE": verified_phone, "VERIFIED_EMAIL": verified_email,
        "PHONE": phone & ~verified_phone, "ADDRESS": _equal("address"), "SOCIAL": _shared("social_urls"), "NAME": _equal("name"), "LOCATION": _equal("city") & _equal("state"),
        "EMAIL_DOMAIN": _equal("email_domain"),
    }
    alike = signals["NAME"] & signals["LOCATION"]
    conflict = alike & F.coalesce((F.col("a.domain") != "") & (F.col("b.domain") != "") & (F.col("a.domain") != F.col("b.domain")), F.lit(False))
    hard = signals["EXTERNAL_ID"] | signals["PLACE_ID"] | signals["DOMAIN"] | verified_phone | verified_email
    return joined.select("p.a", "p.b", *_decide(signals, COMPANY_WEIGHTS, hard, conflict, ~hard & alike))


def match_contacts(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """A decision for each pair of contacts; contacts of different companies never match.

    Records have id, company_id, name, title, email, phone, linkedin_url, social_urls and email_verified.
    """
    joined = pairs.alias("p").join(records.alias("a"), F.col("p.a") == F.col("a.id")).join(records.alias("b"), F.col("p.b") == F.col("b.id"))
    email, title, name = _equal("email"), _equal("title"), _equal("name")
    verified, linked = email & _equal("email_verified"), _equal("linkedin_url")
    one = F.col("a.company_id") == F.col("b.company_id")
    signals = {
        "VERIFIED_EMAIL": verified, "EMAIL": email & ~verified, "PHONE": _equal("phone"), "LINKEDIN": linked, "SOCIAL": _shared("social_urls"), "NAME_TITLE_COMPANY": name & title,
        "NAME_COMPANY": name & ~title, "TITLE": title,
    }
    signals = {k: v & one for k, v in signals.items()}
    hard = signals["VERIFIED_EMAIL"] | signals["LINKEDIN"] | signals["NAME_TITLE_COMPANY"]
    soft = ~hard & (signals["NAME_COMPANY"] | signals["EMAIL"])
    return joined.select("p.a", "p.b", *_decide(signals, CONTACT_WEIGHTS, hard, F.lit(False), soft))


def master_score(status: Column, evidence: Column, contacts: Column, fields: Column) -> Column:
    """How good a master a record is: verified, then rich in evidence, contacts and fields."""
    verified = F.when(status == "VERIFIED", 50).when(status.isin("PARTIALLY_VERIFIED", "SUPPORTED"), 25).when(status.isin("NEEDS_REVIEW", "CONFLICT"), -10).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return verified + zero(evidence) * 3 + zero(contacts) * 2 + zero(fields) * 5


def elect(records: DataFrame, group: str) -> DataFrame:
    """The master of each group: the best score, ties by the smaller id."""
    return records.groupBy(group).agg(F.min_by("id", F.struct((-F.col("master_score")).alias("s"), "id")).alias("master_id"), F.max("master_score").alias("master_score"), F.count("*").alias("members"))


def survive(records: DataFrame, masters: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Each master with its empty fields filled from the losers, who come by score and id."""
    order = F.struct((-F.col("master_score")).alias("s"), "id")
    full = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    # The master comes first in its own order, so its filled fields win.
    picks = [F.min_by(F.when(full(c), F.col(c)), F.when(full(c), order)).alias(c) for c in fields]
    return masters.join(records.groupBy(group).agg(*picks), group)
