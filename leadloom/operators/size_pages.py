"""Sizes of companies from pages: which pages are about the company, and one size out of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import size
from leadloom.functions.urls import same_site

#: Legal forms, and words that do not tell one company from another.
LEGAL = "llc|inc|incorporated|corp|corporation|ltd|limited|company|co"
GENERIC = (
    "the", "and", "llc", "inc", "incorporated", "corp", "corporation", "company", "companies", "group", "holdings", "holding", "investment", "investments", "investor", "investors", "services", "service", "advisors", "advisor", "capital", "resources",
    "partners", "partner",
)
#: Characters around a stated size in which the company must be named, and of the statement by which its place is found.
AROUND, FOUND_BY = 180, 40


def plain(text: Column) -> Column:
    """Lower-case letters and digits, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def comparable(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(plain(name), rf"\b(?:{LEGAL})\b", " "), r"\s+", " "))


def vicinity(text: Column, said: Column) -> Column:
    """The text around a statement; the statement itself where the text does not have it."""
    at = F.position(F.lower(F.substr(said, F.lit(1), F.lit(FOUND_BY))), F.lower(text))
    begin = F.greatest(F.lit(1), at - AROUND)
    return F.when(at == 0, said).otherwise(F.substr(text, begin, at + F.length(said) + AROUND - begin))


def findings(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (company_id, rank, url, title, text) of companies (company_id, name, website, city, state) that state a size: with kind, low, high, excerpt and refused.

    `refused` is why a page is not taken as the company's, null if it is: the page, and what stands around the statement, must
    name the company, or on its own site all words that tell it apart; the name must not go on, by one to four words up to a
    legal form, as another organisation's; and a page of another site must name the company's city, without one its state.
    """
    # Patterns cost much for each text: pages are dealt out over all cores first, and what the patterns find goes through a generator, below which no filter is pushed.
    dealt = pages.repartition(3 * pages.sparkSession.sparkContext.defaultParallelism)
    read = dealt.withColumn("_found", size.extract(F.col("text"))).withColumn("found", F.explode_outer(F.array("_found"))).drop("_found")
    stated = read.filter("found IS NOT NULL").withColumn("excerpt", F.explode_outer(F.array(size.excerpt(F.col("text")))))
    c = {x: F.col(f"_{x}") for x in ("own", "all", "near", "claim", "at", "words", "place")}
    df = stated.join(companies, "company_id").withColumns({
        "_own": comparable(F.col("name")), "_all": plain(F.concat_ws(" ", "title", "text")), "_near": plain(F.concat_ws(" ", F.col("title"), vicinity(F.col("text"), F.col("excerpt")))), "_claim": plain(F.concat_ws(" ", "title", "excerpt")),
        "_official": F.coalesce(same_site(F.col("url"), F.col("website")), F.lit(False)), "_words": F.filter(F.split(plain(F.col("name")), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC)),
        "_place": F.coalesce(F.nullif(plain(F.col("city")), F.lit("")), F.nullif(plain(F.col("state")), F.lit(""))), "_texan": plain(F.col("city")).eqNullSafe("") & plain(F.col("state")).isin("texas", "tx"),
    }).withColumn("_at", F.position(c["own"], c["claim"]))
    named = F.contains(c["all"], c["own"]) & F.contains(c["near"], c["own"])
    told = (F.size(c["words"]) > 0) & F.forall(c["words"], lambda w: F.contains(c["all"], w) & F.contains(c["near"], w))
    begins = (c["at"] == 1) | (F.substr(c["claim"], c["at"] - 1, F.lit(1)) == " ")
    another = (c["at"] > 0) & begins & F.trim(F.substr(c["claim"], c["at"] + F.length(c["own"]))).rlike(rf"^(?:[a-z0-9]+\s+){{1,4}}(?:{LEGAL})\b")
    there = F.coalesce(F.when(F.col("_texan"), F.contains(c["all"], F.lit("texas")) | F.contains(c["all"], F.lit("tx"))).otherwise(F.contains(c["all"], c["place"])), F.lit(False))
    official = F.col("_official")
    refused = F.when(c["own"] == "", "NO_NAME").when(~named & ~(official & told), "NOT_NAMED").when(another, "ANOTHER_ORGANISATION").when(~official & ~there, "NO_PLACE")
    return df.select("company_id", "rank", "url", F.col("found.kind").alias("kind"), F.col("found.low").alias("low"), F.col("found.high").alias("high"), "excerpt", refused.alias("refused"))


def assess(found: DataFrame) -> DataFrame:
    """company_id, outcome, low, high, other_low and other_high of the findings that are not refused, in the order of rank.

    Equal spans of a company are one before they are gathered. Companies without a usable finding have outcome none.
    """
    usable = F.col("refused").isNull() & F.col("kind").isin("exact", "range")
    spans = found.withColumn("usable", usable).groupBy("company_id", F.when(F.col("usable"), F.struct("low", "high")).alias("span")).agg(F.min("rank").alias("rank"))
    gathered = spans.groupBy("company_id").agg(F.array_sort(F.collect_list(F.when(F.col("span").isNotNull(), F.struct("rank", "span.low", "span.high")))).alias("spans"))
    r = F.col("r")
    return gathered.withColumn("r", size.reconcile(F.transform("spans", lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high"))))).select("company_id", *(r[x].alias(x) for x in ("outcome", "low", "high", "other_low", "other_high")))
