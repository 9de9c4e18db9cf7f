"""Leads by everything that can be asked of them: columns of their own, rows of their children, sorted and paged.

Every group of questions about children is a facet, a set of company ids. All facets are found in one tagged union and one aggregate:
a company stays if it has as many different tags as there are facets. So there is one exchange of ids, however many facets are asked.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import score_band
from leadloom.operators.leads import STATE_ALIASES, latest_scores, present
from leadloom.operators.relational import page, with_total

#: What the enumerated questions may be, sort keys, and statuses of a contact that count as verified.
CHOICES = {
    "sort_by": ("score", "company_name", "created_at", "updated_at", "last_verified_at"), "sort_order": ("asc", "desc"), "qualification_status": ("QUALIFIED", "NOT_QUALIFIED", "NEEDS_REVIEW"),
    "classification": ("QUALIFIED", "NOT_QUALIFIED", "INSUFFICIENT_EVIDENCE"), "score_band": ("LOW", "MEDIUM", "HIGH", "VERY_HIGH"),
    "verification_status": ("VERIFIED", "SUPPORTED", "UNVERIFIED", "NOT_FOUND", "CONFLICT", "NEEDS_REVIEW", "INVALID", "PARTIALLY_VERIFIED"),
}
VERIFIED = ("VERIFIED", "PERSON_OWNERSHIP_VERIFIED", "EVIDENCE_VERIFIED", "DELIVERABILITY_VERIFIED")


@dataclass(frozen=True)
class LeadSearch:
    """What is asked; None asks for nothing. Texts are found anywhere in their column, places as a whole, in any case."""

    org_id: int
    page: int = 1
    limit: int = 25
    sort_by: str = "created_at"
    sort_order: str = "desc"
    execution_id: str | None = None
    qualification_status: str | None = None
    classification: str | None = None
    classification_confidence: float | None = None
    min_score: int | None = None
    max_score: int | None = None
    score_band: str | None = None
    verification_status: str | None = None
    last_verified_from: str | None = None
    last_verified_to: str | None = None
    search: str | None = None
    company_name: str | None = None
    website: str | None = None
    domain: str | None = None
    country: str | None = None
    state: str | None = None
    city: str | None = None
    zip_code: str | None = None
    investor_type: str | None = None
    investment_strategy: str | None = None
    property_type: str | None = None
    market_served: str | None = None
    company_size: str | None = None
    contact_title: str | None = None
    has_decision_maker: bool | None = None
    has_verified_contact: bool | None = None
    has_email: bool | None = None
    has_phone: bool | None = None
    has_linkedin: bool | None = None
    has_facebook: bool | None = None
    has_instagram: bool | None = None
    duplicate_status: str | None = None
    created_from: str | None = None
    created_to: str | None = None

    def __post_init__(self):
        for name, choices in CHOICES.items():
            if getattr(self, name) not in (None, *choices):
                raise ValueError(f"{name} must be one of {', '.join(choices)}")
        for bound, most in ((self.min_score, 100), (self.max_score, 100), (self.classification_confidence, 1)):
            if bound is not None and not 0 <= bound <= most:
                raise ValueError(f"scores are 0 to 100 and confidences 0 to 1, not {bound}")
        if self.page < 1 or not 1 <= self.limit <= 100:
            raise ValueError("pages count from 1 and have 1 to 100 rows")

    def asks(self, *names: str) -> bool:
        return any(getattr(self, n) is not None for n in names)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _within(column: str, text: str | None) -> list[Column]:
    return [] if text is None else [F.col(column).ilike(f"%{text}%")]


def _between(column: str, low: str | None, high: str | None) -> list[Column]:
    return [F.col(column) >= F.lit(low).cast("timestamp")] * (low is not None) + [F.col(column) <= F.lit(high).cast("timestamp")] * (high is not None)


def own_conditions(s: LeadSearch) -> Column:
    """The predicate on companies alone; it reaches their scan."""
    out = [F.col("org_id") == s.org_id, *_within("name", s.company_name), *_within("website", s.website), *_within("website", s.domain), *_within("investment_strategy", s.investment_strategy), *_between("created_at", s.created_from, s.created_to)]
    if s.search is not None:
        out.append(reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for x in ("name", "website", "description") for c in _within(x, s.search))))
    if s.investor_type is not None:
        out.append(F.col("investor_type") == s.investor_type)
    if s.company_size is not None:
        count = F.col("employee_count") == (int(s.company_size) if s.company_size.isdigit() and int(s.company_size) else -1)
        out.append(F.coalesce(F.col("employee_range") == s.company_size, F.lit(False)) | F.coalesce(count, F.lit(False)))
    for column, text in (("property_types", s.property_type), ("markets_served", s.market_served)):
        out += [F.to_json(column).ilike(f"%{text}%")] if text is not None else []
    for wanted, column in ((s.has_email, "email"), (s.has_phone, "phone")):
        if wanted is not None:
            there = F.coalesce(present(column), F.lit(False))
            out.append(there if wanted else ~there)
    return _all(out)


def facets(tables: dict[str, DataFrame], s: LeadSearch) -> list[DataFrame]:
    """A frame of company ids for each group of questions about children that is asked, those of other organisations among them or not."""
    out = []

    def add(table: str, conditions: list[Column], column: str = "company_id") -> None:
        out.append(tables[table].filter(_all(conditions)).select(F.col(column).alias("id")))

    if s.execution_id is not None:
        add("sources", [F.col("org_id") == s.org_id, F.col("execution_id") == s.execution_id])
    if s.asks("classification", "classification_confidence"):
        add("classifications", [F.col("org_id") == s.org_id, *([F.col("decision") == s.classification] if s.classification else []), *([F.col("confidence") >= s.classification_confidence] if s.classification_confidence is not None else [])])
    if s.asks("min_score", "max_score", "score_band"):
        latest = latest_scores(tables["scores"])
        wanted = F.col("score").between(s.min_score if s.min_score is not None else 0, s.max_score if s.max_score is not None else 100)
        out.append(latest.filter(wanted if s.score_band is None else wanted & (score_band(F.col("score")) == s.score_band)).select(F.col("company_id").alias("id")))
    if s.asks("verification_status", "last_verified_from", "last_verified_to"):
        add("verifications", [F.col("org_id") == s.org_id, *([F.col("status") == s.verification_status] if s.verification_status else []), *_between("checked_at", s.last_verified_from, s.last_verified_to)])
    if s.asks("has_decision_maker", "has_verified_contact", "contact_title", "has_linkedin", "has_facebook", "has_instagram"):
        asked = _within("title", s.contact_title)
        for column, wanted in (("full_name", s.has_decision_maker), ("linkedin_url", s.has_linkedin), ("facebook_url", s.has_facebook), ("instagram_url", s.has_instagram)):
            asked += [F.col(column).isNotNull() if wanted else F.col(column).isNull()] if wanted is not None else []
        if s.has_verified_contact is not None:
            verified = F.coalesce(F.col("verification_status").isin(*VERIFIED), F.lit(False)) | F.coalesce(F.col("email_status").isin(*VERIFIED), F.lit(False))
            asked.append(verified if s.has_verified_contact else ~verified)
        add("contacts", asked)
    if s.asks("state", "city", "country", "zip_code"):
        where = [F.col(c).ilike(v) for c, v in (("city", s.city), ("country", s.country)) if v is not None] + ([F.col("postal_code") == s.zip_code] if s.zip_code is not None else [])
        if s.state is not None:
            where.append(reduce(lambda a, b: a | b, (F.col("state").ilike(t) for t in STATE_ALIASES.get(s.state.strip().lower(), (s.state.strip(),)))))
        add("locations", where)
    if s.duplicate_status is not None:
        add("duplicates", [F.col("org_id") == s.org_id, F.col("entity_type") == "COMPANY", F.col("status") == s.duplicate_status], "entity_a_id")
    if s.qualification_status is not None:
        add("qualifications", [F.col("org_id") == s.org_id, F.col("status") == s.qualification_status, *([F.col("execution_id") == s.execution_id] if s.execution_id is not None else [])])
    return out


def matching(tables: dict[str, DataFrame], s: LeadSearch) -> DataFrame:
    """The companies of the organisation that all that is asked holds for."""
    found, asked = tables["companies"].filter(own_conditions(s)), facets(tables, s)
    if not asked:
        return found
    tagged = reduce(DataFrame.unionByName, (f.withColumn("tag", F.lit(1 << i)) for i, f in enumerate(asked)))
    # Tags are bits, so that they combine before the exchange.
    full = tagged.groupBy("id").agg(F.bit_or("tag").alias("tags")).filter(F.col("tags") == (1 << len(asked)) - 1)
    return found.join(full.select("id"), "id", "left_semi")


def search(tables: dict[str, DataFrame], s: LeadSearch) -> DataFrame:
    """A page of the matching companies with score, total and total_pages; a lead without a score counts as -1, equal rows come by id.

    `tables` has companies (id, org_id, name, website, description, investor_type, investment_strategy, property_types, markets_served, employee_count,
    employee_range, email, phone, created_at, updated_at, last_verified_at), scores, and of sources, classifications, verifications, contacts, locations,
    duplicates and qualifications those that are asked about. Nulls never match a text, sort last downwards and first upwards.
    """
    found = matching(tables, s)
    latest = latest_scores(tables["scores"]).select(F.col("company_id").alias("id"), "score")
    ranked = found.join(latest, "id", "left").withColumn("score", F.coalesce("score", F.lit(-1)))
    key = F.col("name" if s.sort_by == "company_name" else s.sort_by)
    order = [key.asc_nulls_first() if s.sort_order == "asc" else key.desc_nulls_last(), F.asc("id")]
    return with_total(page(ranked, order, s.page, s.limit), found, s.limit)


#: Every question that can be asked, for callers that build a search of named values.
QUESTIONS = tuple(f.name for f in fields(LeadSearch))
