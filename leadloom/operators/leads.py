"""Lead listing: filters, facets, latest scores, paging, hydration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.relational import intersect_ids, latest_by, page, with_total

#: Bounds that stand for a missing one.
LEAST, MOST = -2147483648, 2147483647
#: Spellings of a state that count as one.
STATE_ALIASES = {"texas": ("Texas", "TX"), "tx": ("Texas", "TX")}


@dataclass(frozen=True)
class LeadFilter:
    """What a listing may ask for; None asks for nothing."""

    org_id: int
    search: str | None = None
    state: str | None = None
    created_from: str | None = None
    created_to: str | None = None
    has_email: bool | None = None
    has_phone: bool | None = None
    size_min: int | None = None
    size_max: int | None = None
    size_status: str | None = None
    min_score: int | None = None
    max_score: int | None = None

    def __post_init__(self):
        for bound in (self.min_score, self.max_score):
            if bound is not None and not 0 <= bound <= 100:
                raise ValueError("scores are 0 to 100")
        if self.size_status not in (None, "MATCHED", "UNKNOWN", "OUTSIDE_RANGE"):
            raise ValueError("unknown size status")


def present(column: str) -> Column:
    """Not null, and not blank."""
    return F.col(column).isNotNull() & (F.length(F.trim(column)) > 0)


def size_span(column: str) -> tuple[Column, Column]:
    """Ends of an `a-b` range (a dash or an en dash, nothing around it), null for anything else."""
    plain = F.replace(F.col(column), F.lit("–"), F.lit("-"))
    part = lambda i: F.nullif(F.regexp_extract(plain, "^([0-9]+)-([0-9]+)$", i), F.lit("")).try_cast("int")
    return part(1), part(2)


def size_status(low: int | None, high: int | None, count: str = "employee_count", span: str = "employee_range") -> Column:
    """MATCHED, OUTSIDE_RANGE or UNKNOWN against bounds: by the count, else by the range."""
    low, high = LEAST if low is None else low, MOST if high is None else high
    a, b = size_span(span)
    return (
        F.when(F.col(count).isNotNull(), F.when(F.col(count).between(low, high), "MATCHED").otherwise("OUTSIDE_RANGE"))
        .when((a >= low) & (b <= high) & (a <= b), "MATCHED")
        .when((b < low) | (a > high), "OUTSIDE_RANGE")
        .otherwise("UNKNOWN")
    )


def conditions(f: LeadFilter) -> Column:
    """The row predicate of a filter; the tenant comes first and every alternative is bracketed."""
    out = F.col("org_id") == f.org_id
    if f.search is not None:
        out &= F.col("name").ilike(f"%{f.search}%") | F.col("website").ilike(f"%{f.search}%")
    if f.state is not None:
        terms = STATE_ALIASES.get(f.state.strip().lower(), (f.state.strip(),))
        wanted = F.lit(False)
        for term in terms:
            wanted |= F.col("state").ilike(term)
        out &= wanted
    if f.created_from is not None:
        out &= F.col("created_at") >= F.lit(f.created_from).cast("timestamp")
    if f.created_to is not None:
        out &= F.col("created_at") <= F.lit(f.created_to).cast("timestamp")
    for wanted_, column in ((f.has_email, "email"), (f.has_phone, "phone")):
        if wanted_ is not None:
            out &= present(column) if wanted_ else ~present(column)
    if f.size_status is not None:
        out &= size_status(f.size_min, f.size_max) == f.size_status
    return out


def latest_scores(scores: DataFrame) -> DataFrame:
    """The newest score of each company, ties by the larger id."""
    return latest_by(scores, ["company_id"], ["calculated_at", "id"])


def listing(companies: DataFrame, scores: DataFrame, f: LeadFilter, number: int = 1, size: int = 25, facets: list[DataFrame] | None = None) -> DataFrame:
    """A page of leads by latest score, best first, with the totals; a lead without a score counts as -1."""
    latest = latest_scores(scores).select(F.col("company_id").alias("id"), "score")
    found = companies.filter(conditions(f))
    if f.min_score is not None or f.max_score is not None:
        within = latest.filter(F.col("score").between(0 if f.min_score is None else f.min_score, 100 if f.max_score is None else f.max_score))
        facets = [*(facets or []), within.select("id")]
    found = intersect_ids(found, "id", facets or [])
    ranked = found.join(latest, "id", "left").withColumn("score", F.coalesce("score", F.lit(-1)))
    return with_total(page(ranked, [F.desc("score"), F.asc("id")], number, size), found, size)
