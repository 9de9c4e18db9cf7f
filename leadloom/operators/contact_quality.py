"""How well stored evidence supports a contact: a status for each field, conflicts and a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import contact_phone
from leadloom.functions.urls import host
from leadloom.operators.evidence import COPY_CHARS, source_key

#: Hosts of a platform's profiles.
PLATFORMS = {"linkedin": ("linkedin.com",), "facebook": ("facebook.com",), "instagram": ("instagram.com",), "youtube": ("youtube.com", "youtu.be")}
#: First words of a title that was held before.
FORMER = ("former", "ex", "previous")
#: Points of a verified and of a supported field; a conflict costs what support brings.
POINTS = {"name": (20, 10), "relationship": (15, 8), "title": (20, 10), "email": (15, 8)}
#: Points of the best social profile, of each source and of all, of fresh and of older evidence, and of any conflict.
SOCIAL_POINTS, SOURCE_POINTS, MOST_SOURCE_POINTS, FRESH_POINTS, OLD_POINTS, CONFLICT_POINTS = (10, 5), 5, 10, 10, 4, -10


def held_title(title: Column) -> tuple[Column, Column]:
    """A title in lower case without a word for former, and whether it had one."""
    flat = F.lower(F.trim(F.regexp_replace(F.regexp_replace(title, "[_-]", " "), r"\s+", " ")))
    former = "|".join(FORMER)
    return F.regexp_replace(flat, rf"^({former})\s+", ""), flat.rlike(rf"^({former})\b")


def _tidy(c: Column) -> Column:
    return F.lower(F.trim(c))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def contact_quality(contacts: DataFrame, evidence: DataFrame, roles: list[str], fresh_days: int, as_of: Column) -> DataFrame:
    """One row for each contact: a status for each field, the matched role, what kind of phone it is, conflicts and a score from 0 to 100.

    Contacts have id, full_name, title, email, phone, linkedin_url, facebook_url, instagram_url, youtube_url, company,
    website and company_phone. Evidence has contact_id, id, field, value, source_type, source_url, excerpt and retrieved_at.

    Evidence is summed by (contact, independent source) before it is summed by contact: a long excerpt is the
    same source wherever it stands. Nothing is gathered into lists, so a contact with very much evidence is one like others.
    """
    person = F.lower(F.trim(F.regexp_replace("full_name", r"\s+", " ")))
    pieces = evidence.withColumnRenamed("id", "evidence_id").join(contacts.withColumnRenamed("id", "contact_id"), "contact_id").withColumns({"value": F.coalesce("value", F.lit("")), "excerpt": F.coalesce("excerpt", F.lit(""))})
    norm, historical = held_title(F.col("value"))
    is_title = F.col("field").isin("title", "normalizedRole")
    number = contact_phone(F.col("value"))
    kind = F.when(is_title, F.when(historical, "former").otherwise("title")).when((F.col("field") == "email") & ~_blank(F.col("value")), "email").when((F.col("field") == "phone") & number.isNotNull(), "phone")
    claimed = F.when(is_title, norm).when(F.col("field") == "email", _tidy(F.col("value"))).when(F.col("field") == "phone", number)
    pieces = pieces.withColumns({"kind": kind, "claimed": F.when(kind.isNotNull(), claimed)})

    # What is claimed: distinct values of each kind, in the order in which they were found.
    values = pieces.filter("kind IS NOT NULL").groupBy("contact_id", "kind", "claimed").agg(F.min(F.struct("evidence_id", "value")).alias("first"))
    of = lambda k, c: F.when(F.col("kind") == k, c)
    claims = values.groupBy("contact_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("title", "former", "email", "phone")),
        *(F.min(of(k, F.struct("first", "claimed"))).alias(f"first_{k}") for k in ("title", "former", "email", "phone")),
    )
    known = contacts.withColumnRenamed("id", "contact_id").join(claims, "contact_id", "left").fillna(0, [f"n_{k}" for k in ("title", "former", "email", "phone")])
    stored_title, stored_former = held_title(F.coalesce("title", F.lit("")))
    picked = F.coalesce(F.col("first_title.claimed"), F.col("first_former.claimed"))
    known = known.select(
        "contact_id",
        F.coalesce(picked, stored_title).alias("held"), F.when(picked.isNotNull(), F.col("first_title").isNull()).otherwise(stored_former).alias("held_before"), picked.isNotNull().alias("title_claimed"),
        _tidy(F.coalesce("email", F.col("first_email.first.value"))).alias("email_value"), F.coalesce(contact_phone(F.col("phone")), F.col("first_phone.claimed")).alias("phone_value"),
        contact_phone(F.col("company_phone")).alias("switchboard"),
        ((F.col("n_title") > 1) | ((F.col("n_title") == 1) & (F.col("n_former") == 1) & (F.col("first_title.claimed") != F.col("first_former.claimed")))).alias("title_conflict"),
        (F.col("n_email") > 1).alias("email_conflict"), (F.col("n_phone") > 1).alias("phone_conflict"), (F.col("n_email") > 0).alias("email_claimed"), (F.col("n_phone") > 0).alias("phone_claimed"),
        (F.col("n_former") > 0).alias("has_former"),
    )

    # Which pieces bear a field out, and from how many independent sources.
    low = F.lower("excerpt")
    named = low.contains(person)
    site = host(F.col("website"))
    linked = named & (F.lower(F.concat_ws(" ", "excerpt", "value")).contains(_tidy(F.col("company"))) | F.coalesce(host(F.col("source_url")) == site, F.lit(False)))
    digits = F.regexp_replace("phone_value", "[^0-9]", "")
    assigned = F.exists(F.split("excerpt", r"[.\n]"), lambda s: F.regexp_replace(s, "[^0-9]", "").contains(digits) & F.lower(s).contains(person))
    # Worked out once a piece, as columns: many flags use them.
    borne = {"is_named": named, "is_linked": linked}
    named, linked = F.col("is_named"), F.col("is_linked")
    flags = {
        "any": F.lit(True), "name": named, "linked": linked,
        "title": is_title & (norm == F.col("held")) & (historical == F.col("held_before")),
        "email": (F.col("kind") == "email") & (F.col("claimed") == F.col("email_value")) & named,
        "phone": (F.col("kind") == "phone") & (digits != "") & assigned,
    }
    for platform, hosts in PLATFORMS.items():
        flags[platform] = linked & (F.col("field").isin(platform, f"{platform}Url") | ((F.col("field") == "profileUrl") & F.coalesce(F.col("value_host").isin(*hosts), F.lit(False))))
    text = F.lower(F.trim(F.regexp_replace("excerpt", r"\s+", " ")))
    source = F.when(F.length(text) >= COPY_CHARS, F.concat(F.lit("copy|"), text)).otherwise(source_key(F.col("source_url"), F.col("source_type")))
    by_source = (
        pieces.join(known.select("contact_id", "held", "held_before", "email_value", "phone_value"), "contact_id")
        .withColumns(borne | {"value_host": F.when(F.col("field") == "profileUrl", host(F.col("value")))})
        .groupBy("contact_id", F.sha2(source, 256).alias("source"))
        .agg(*(F.max(F.when(F.coalesce(c, F.lit(False)), F.col("retrieved_at"))).alias(k) for k, c in flags.items()))
    )
    summed = by_source.groupBy("contact_id").agg(*(F.count(k).alias(f"s_{k}") for k in flags), *(F.max(k).alias(f"at_{k}") for k in flags))
    joined = contacts.withColumnRenamed("id", "contact_id").join(known, "contact_id").join(summed, "contact_id", "left").fillna(0, [f"s_{k}" for k in flags])

    age = lambda at: (F.unix_micros(as_of) - F.unix_micros(at.cast("timestamp"))) / 86400e6
    current = lambda status, at: F.when((status == "VERIFIED") & F.coalesce(age(at) > fresh_days, F.lit(False)), "SUPPORTED").otherwise(status)
    counted = lambda k: F.when(F.col(f"s_{k}") >= 2, "VERIFIED").otherwise("SUPPORTED")
    tied = F.col("s_linked") > 0
    name = F.when(_blank(F.col("full_name")), "NOT_FOUND").when((F.col("s_name") == 0) | ~tied, "UNVERIFIED").otherwise(counted("name"))
    relation = F.when(tied, counted("linked")).when(~_blank(F.col("full_name")), "UNVERIFIED").otherwise("NOT_FOUND")
    title = (
        F.when(F.col("title_conflict"), "CONFLICT").when(~F.col("title_claimed"), F.when(F.coalesce("title", F.lit("")) != "", "UNVERIFIED").otherwise("NOT_FOUND"))
        .when(~tied, "UNVERIFIED").when(F.col("held_before"), "SUPPORTED").otherwise(counted("title"))
    )
    email = F.when(F.col("email_conflict"), "CONFLICT").when(~F.col("email_claimed"), "NOT_FOUND").when(F.col("s_email") == 0, "UNVERIFIED").when(tied, counted("email")).otherwise("SUPPORTED")
    own_line = F.coalesce(F.col("phone_value") == F.col("switchboard"), F.lit(False))
    phone = F.when(F.col("phone_conflict"), "CONFLICT").when(~F.col("phone_claimed"), "NOT_FOUND").when((F.col("s_phone") == 0) | own_line, "UNVERIFIED").when(tied, counted("phone")).otherwise("SUPPORTED")
    line = F.when(F.col("phone_conflict") | ~F.col("phone_claimed"), "UNKNOWN").when(own_line, "COMPANY_PHONE").when(F.col("s_phone") == 0, "UNKNOWN").otherwise("PERSONAL_PUBLIC_PHONE")
    status = {"name": current(name, F.col("at_name")), "relationship": current(relation, F.col("at_linked")), "title": current(title, F.when(~F.col("title_conflict"), F.col("at_title"))), "email": current(email, F.col("at_email")), "phone": current(phone, F.col("at_phone"))}
    for platform, hosts in PLATFORMS.items():
        url = F.col(f"{platform}_url")
        whole = F.coalesce(F.try_parse_url(F.trim(url), F.lit("HOST")).isNotNull() & host(url).isin(*hosts), F.lit(False))
        status[platform] = current(F.when(_blank(url), "NOT_FOUND").when(~whole | (F.col(f"s_{platform}") == 0) | ~tied, "UNVERIFIED").otherwise(counted(platform)), F.col(f"at_{platform}"))
    rated = joined.select("*", *(s.alias(f"{k}_status") for k, s in status.items()))

    conflicts = sum((F.col(f"{k}_conflict").cast("int") for k in ("title", "email", "phone")), F.lit(0))
    points = [F.when(F.col(f"{k}_status") == "VERIFIED", a).when(F.col(f"{k}_status") == "SUPPORTED", b).when(F.col(f"{k}_status") == "CONFLICT", -b).otherwise(0) for k, (a, b) in POINTS.items()]
    profiles = F.array(*(F.col(f"{p}_status") for p in PLATFORMS))
    points.append(F.when(F.array_contains(profiles, "VERIFIED"), SOCIAL_POINTS[0]).when(F.array_contains(profiles, "SUPPORTED"), SOCIAL_POINTS[1]).otherwise(0))
    points.append(F.least(F.lit(MOST_SOURCE_POINTS), F.col("s_any") * SOURCE_POINTS))
    points.append(F.when(F.col("at_any").isNull(), 0).when(F.greatest(F.lit(0.0), age(F.col("at_any"))) <= fresh_days, FRESH_POINTS).otherwise(OLD_POINTS))
    points.append(F.when(conflicts > 0, CONFLICT_POINTS).otherwise(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), reduce(lambda a, b: a + b, points)))
    wanted = F.array(*map(F.lit, roles))
    role = F.when(tied & ~F.col("held_before") & ~F.col("title_conflict"), F.get(F.filter(wanted, lambda r: held_title(r)[0] == F.col("held")), 0))
    return rated.select(
        F.col("contact_id").alias("id"), *(F.col(f"{k}_status") for k in status), role.alias("matched_role"), line.alias("phone_kind"), ((F.col("s_email") > 0) & F.col("email_claimed") & ~F.col("email_conflict")).alias("email_owned"),
        conflicts.alias("conflicts"), F.col("s_any").alias("independent_sources"), F.col("at_any").alias("retrieved_at"), score.cast("int").alias("quality_score"),
    )
