"""Claims, independent sources, reconciliation into statuses, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.urls import registrable_domain
from leadloom.operators.relational import latest_by

#: Characters from which equal excerpts count as copies.
COPY_CHARS = 80


def source_key(url: Column, provider: Column) -> Column:
    """Who a piece of evidence comes from: the registrable domain, else the provider."""
    domain = registrable_domain(url)
    return F.when(domain.isNotNull(), F.concat(F.lit("domain:"), domain)).otherwise(F.concat(F.lit("provider:"), F.coalesce(provider, F.lit("unknown"))))


def normal_value(field: Column, value: Column) -> Column:
    """What makes two claimed values of a field equal."""
    return F.when(field == "phone", F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(F.trim(value)))


def borne_out(stored: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(company_id, field, text_sources): from how many independent sources an excerpt (company_id, text, source_url, provider) has the stored value in it.

    Excerpts of one company that come from one source are told apart by their text, so each is looked at once.
    """
    source = source_key(F.col("source_url"), F.col("provider"))
    texts = excerpts.select("company_id", F.lower("text").alias("text"), source.alias("source")).filter("text <> ''").distinct()
    values = stored.filter("trim(value) <> ''").select("company_id", "field", F.lower(F.trim("value")).alias("wanted")).distinct()
    held = values.join(texts, "company_id").filter(F.contains("text", "wanted"))
    return held.groupBy("company_id", "field").agg(F.countDistinct("source").alias("text_sources"))


def reconcile(evidence: DataFrame, stored: DataFrame, excerpts: DataFrame | None = None) -> DataFrame:
    """A status for each stored value (company_id, field, value) from the claims on its field.

    Several distinct values need review and name a conflict, the first claims of the first two
    values. Else claims equal to the stored value verify it, from two independent sources on, or
    support it. Claims come by id; aggregation is by (entity, field, value) first, and of a field's
    values only the first two of each task go on.
    """
    claims = evidence.filter(F.col("value").isNotNull() & (F.col("value") != "")).withColumn("norm", normal_value(F.col("field"), F.col("value"))).withColumn("source", source_key(F.col("source_url"), F.col("provider")))
    # A source that says the same again says nothing new.
    distinct = claims.groupBy("company_id", "field", "norm", "source").agg(F.min(F.struct("id", "value")).alias("first"))
    by_value = distinct.groupBy("company_id", "field", "norm").agg(F.count("*").alias("sources"), F.min("first").alias("first"))
    # Two values name a conflict and one may be the stored one: nothing is gathered, however many values a field has.
    order = Window.partitionBy("company_id", "field").orderBy("first")
    two = by_value.withColumn("place", F.row_number().over(order)).filter("place <= 2")
    by_field = two.groupBy("company_id", "field").agg(F.count("*").alias("n_values"), *(F.max(F.when(F.col("place") == i, F.col("first.value"))).alias(n) for i, n in ((1, "value_a"), (2, "value_b"))))
    wanted = stored.withColumn("norm", normal_value(F.col("field"), F.col("value")))
    joined = wanted.join(by_field, ["company_id", "field"], "left").join(by_value.select("company_id", "field", "norm", "sources"), ["company_id", "field", "norm"], "left")
    sources = F.coalesce("sources", F.lit(0))
    if excerpts is not None:
        joined = joined.join(borne_out(stored, excerpts), ["company_id", "field"], "left")
        sources = F.when(sources > 0, sources).otherwise(F.coalesce("text_sources", F.lit(0)))
    status = (
        F.when(F.col("value").isNull() | (F.col("value") == ""), "NOT_FOUND")
        .when(F.col("n_values") > 1, "NEEDS_REVIEW")
        .when(sources >= 2, "VERIFIED")
        .when(sources == 1, "SUPPORTED")
        .otherwise("UNVERIFIED")
    )
    review = status == "NEEDS_REVIEW"
    return joined.select(
        "company_id", "field", status.alias("status"),
        F.when(status == "VERIFIED", 0.9).when(status == "SUPPORTED", 0.75).alias("confidence"),
        F.when(review, F.lit(0).cast("long")).otherwise(sources).alias("source_count"),
        F.when(review, F.col("value_a")).alias("conflict_a"), F.when(review, F.col("value_b")).alias("conflict_b"),
    )


def latest_fields(verifications: DataFrame) -> DataFrame:
    """The newest verification of each company's field, ties by the larger id."""
    return latest_by(verifications, ["company_id", "field"], ["checked_at", "id", "status"])


def display_status(field: Column, status: Column, kind: Column | None = None) -> Column:
    """What is shown for a field; e-mail fields have a ladder of their own."""
    kind = F.lit(None).cast("string") if kind is None else kind
    email = (
        F.when(kind == "ownership", "PERSON_OWNERSHIP_VERIFIED").when(kind == "deliverability", "DELIVERABILITY_VERIFIED")
        .when((kind == "independent_evidence") | status.isin("VERIFIED", "EVIDENCE_VERIFIED"), "EVIDENCE_VERIFIED")
        .when((kind == "evidence_supported") | status.isin("SUPPORTED", "EVIDENCE_SUPPORTED"), "EVIDENCE_SUPPORTED")
        .when((kind == "syntax") | status.isin("SYNTAX", "SYNTAX_VALID"), "SYNTAX_VALID")
    )
    other = F.when(status == "VERIFIED", "EVIDENCE_VERIFIED").when(status.isin("SUPPORTED", "EVIDENCE_SUPPORTED"), "EVIDENCE_SUPPORTED").when(status == "", "NOT_FOUND").otherwise(status)
    return F.when(F.lower(field).contains("email"), F.coalesce(email, other)).otherwise(other)


def summarize(fields: DataFrame) -> DataFrame:
    """The aggregate verification status of each company over its fields (without ownership or delivery checks)."""
    shown = fields.withColumn("shown", display_status(F.col("field"), F.col("status")))
    flags = shown.groupBy("company_id").agg(
        F.bool_and(F.col("status") == "NOT_FOUND").alias("nothing"),
        F.bool_or(F.col("status").isin("NEEDS_REVIEW", "CONFLICT")).alias("needs_review"),
        F.bool_or(F.col("status") == "CONFLICT").alias("conflict"),
        F.bool_and((F.col("shown") == "EVIDENCE_VERIFIED") | (F.col("status") == "VERIFIED")).alias("all_verified"),
        F.bool_or((F.col("shown") == "EVIDENCE_VERIFIED") | F.col("shown").isin("SUPPORTED", "EVIDENCE_SUPPORTED")).alias("some"),
        F.count("*").alias("n_fields"),
    )
    status = F.when(F.col("nothing"), "NOT_FOUND").when(F.col("needs_review"), "NEEDS_REVIEW").when(F.col("all_verified"), "VERIFIED").when(F.col("some"), "PARTIALLY_VERIFIED").otherwise("UNVERIFIED")
    return flags.select("company_id", "n_fields", "needs_review", "conflict", status.alias("status"))


def independent_copies(evidence: DataFrame, excerpt: str, url: str, keys: list[str]) -> DataFrame:
    """Independent pieces of evidence: long excerpts collapse by text, others by domain."""
    text = F.lower(F.trim(F.regexp_replace(excerpt, r"\s+", " ")))
    key = F.when(F.length(text) >= COPY_CHARS, F.concat(F.lit("text:"), text)).otherwise(F.concat(F.lit("domain:"), F.coalesce(registrable_domain(F.col(url)), F.lit(""))))
    return evidence.withColumn("_key", F.sha2(key, 256)).groupBy(*keys).agg(F.countDistinct("_key").alias("independent"), F.count("*").alias("pieces"))


def merge_evidence(groups: list[DataFrame]) -> DataFrame:
    """Lists of evidence (id, url, excerpt, kind and more) as one: a piece stays once, from the first list that has it,
    told by its id or, without one, by its source, excerpt and kind."""
    numbered = [g.withColumn("_list", F.lit(k)) for k, g in enumerate(groups)]
    every = numbered[0]
    for more in numbered[1:]:
        every = every.unionByName(more)
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.when(part("id") != "", F.concat(F.lit("id:"), "id")).otherwise(F.concat_ws("|", part("url"), part("excerpt"), part("kind")))
    row = F.struct(*groups[0].columns)
    return every.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct("_list", row)).alias("_row")).select("_row.*")
