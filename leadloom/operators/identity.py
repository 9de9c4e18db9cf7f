"""Which stored entity a found one is, and found people that are one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.discovery import agreeing

#: Language that denies a purchase.
DENIED_PURCHASE = r"(?i)\b(?:do\s+not|don't|does\s+not|doesn't|never|no longer)\s+[^.?]{0,20}\b(?:buy|purchase|acqui)"
#: Words that say nothing about what a query looks for, and the fewest letters of one that does.
QUERY_FILLERS, QUERY_LETTERS = ("the", "and", "for", "with", "from", "site", "official", "website"), 3
#: Words of roles, of which two like queries share one.
ROLE_WORDS = ("ceo", "founder", "owner", "president", "director", "partner", "manager", "leadership", "team", "contact", "email", "linkedin")


def lookup(found: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, company_id, key) for each found entity that a stored one shares a key with, and whose places may be one.

    Both have id, city, lat and lon and the columns `keys`, the strongest first; blank keys do not count. The first key by which
    a stored entity is found decides, of several stored ones the smallest id. Stored entities are summed up by key and place before they
    are joined, so a key that very many share costs no more than another.
    """
    listed = F.array(*(F.struct(F.lit(k).alias("rank"), F.lower(F.trim(F.col(c).cast("string"))).alias("key")) for k, c in enumerate(keys)))
    apart = lambda df: df.select("id", "city", "lat", "lon", F.explode(F.filter(listed, lambda x: F.coalesce(x["key"], F.lit("")) != "")).alias("k")).select("id", "city", "lat", "lon", "k.rank", "k.key")
    hits = agreeing(apart(found), apart(stored), ["rank", "key"], {"h": F.min(F.struct("rank", F.col("id").alias("company_id")))}, {"h": F.min})
    return hits.select("id", "h.company_id", F.get(F.array(*map(F.lit, keys)), F.col("h.rank")).alias("key"))


def fold_people(people: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """People with equal keys (whatever the case) as one: the first in order, its empty fields filled from the next ones, and how many there were."""
    rank = F.struct(*order)
    full = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    tidy = [F.lower(F.trim(F.col(k).cast("string"))).alias(f"_{k}") for k in keys]
    picks = [F.min_by(k, rank).alias(k) for k in keys] + [F.min_by(F.col(c), F.when(full(c), rank)).alias(c) for c in fields]
    return people.groupBy(*tidy).agg(*picks, F.count("*").alias("n")).drop(*(f"_{k}" for k in keys))


def first_match(evidence: DataFrame, keys: Sequence[str], pattern: str, order: str, affirmed: bool = False) -> DataFrame:
    """The first piece of evidence of each key whose text has a pattern, ties by text and URL; `affirmed` leaves out texts that deny a purchase."""
    hit = F.col("text").rlike(pattern)
    if affirmed:
        hit &= ~F.col("text").rlike(DENIED_PURCHASE)
    return evidence.filter(hit).groupBy(*keys).agg(F.min_by(F.struct("text", "url"), F.struct(order, "text", "url")).alias("m")).select(*keys, "m.text", "m.url")


def telling_words(query: Column) -> Column:
    """The words of a query that say what it looks for."""
    return F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda w: (F.length(w) >= QUERY_LETTERS) & ~w.isin(*QUERY_FILLERS)))


def near_duplicate_query(issued: Column, candidate: Column) -> Column:
    """Whether a query asks again what one before asked: two words in common, and a role in both or in neither."""
    a, b = telling_words(issued), telling_words(candidate)
    roles = F.array(*map(F.lit, ROLE_WORDS))
    own, other = F.array_intersect(a, roles), F.array_intersect(b, roles)
    alike = F.arrays_overlap(own, other) | ((F.size(own) == 0) & (F.size(other) == 0))
    return (F.size(a) >= 2) & (F.size(b) >= 2) & (F.size(F.array_intersect(a, b)) >= 2) & F.coalesce(alike, F.lit(False))


def stage_progress(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each stage: first start, last completion after the last start, duration and waiting, from events (kind, at_ms, wait_ms, failed).

    A stage that was started again after it was completed is open. Waiting before the first start does not count.
    """
    on = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    starts = events.groupBy(*keys).agg(F.min(on("started", "at_ms")).alias("started_at"), F.max(on("started", "at_ms")).alias("last_start"), F.max(on("completed", "at_ms")).alias("completed_at"), F.count_if(F.col("kind") == "started").alias("batches"))
    waits = events.filter("kind = 'waited'").join(starts.select(*keys, "started_at"), list(keys)).filter("at_ms >= started_at").groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("wait_ms"))).alias("waiting_ms"))
    done = F.col("completed_at") >= F.coalesce("last_start", "completed_at")
    began = F.coalesce("started_at", "completed_at")
    return starts.join(waits, list(keys), "left").select(
        *keys, began.alias("started_at"), F.when(done, F.col("completed_at")).alias("completed_at"), F.when(done, F.greatest(F.lit(0), F.col("completed_at") - began)).alias("duration_ms"), F.coalesce("waiting_ms", F.lit(0)).alias("waiting_ms"), "batches"
    )


def masked(counters: dict[str, Column], stages: dict[str, str]) -> list[Column]:
    """Counters that show only once their stage has left PENDING: `stages` names the column of each counter's stage."""
    return [(F.when(F.col(stages[name]) != "PENDING", value) if name in stages else value).alias(name) for name, value in counters.items()]


def settled(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state for the jobs of each key (state, website_status): PENDING while one runs, FAILED if all failed, PARTIAL if some did or a site is missing."""
    n, failed = F.count("*"), F.count_if(F.col("state") == "failed")
    out = jobs.groupBy(*keys).agg(
        n.alias("jobs"), failed.alias("failed"), F.count_if(~F.col("state").isin("completed", "failed", "missing")).alias("running"), F.count_if(F.col("website_status") == "FOUND").alias("found"), F.count_if(F.col("website_status").isin("NOT_FOUND", "LIMITED")).alias("without")
    )
    state = (
        F.when(F.col("running") > 0, "PENDING").when(F.col("failed") == F.col("jobs"), "FAILED").when((F.col("failed") > 0) | (F.col("without") > 0), "PARTIAL").otherwise("COMPLETED")
    )
    return out.select(*keys, state.alias("state"), "jobs", "found")


def citations(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of each decision (decision, cited: ids): how many cited ids are stored evidence (id), how many are not, and whether any is. Blank and repeated ids count once or not at all."""
    cited = decisions.select("decision", F.explode_outer(F.array_distinct(F.array_compact("cited"))).alias("id"))
    known = evidence.select("id").distinct().withColumn("there", F.lit(True))
    kept = F.count_if(F.col("there"))
    return cited.join(known, "id", "left").groupBy("decision").agg(kept.alias("kept"), F.count_if(F.col("id").isNotNull() & F.col("there").isNull()).alias("dropped"), (kept > 0).alias("backed"))
