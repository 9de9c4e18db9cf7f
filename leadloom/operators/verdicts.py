"""Verdicts over evidence texts: categories, exclusions, ownership, identity, agreement."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import is_generic_mailbox
from leadloom.operators.evidence import source_key

#: Phrases of distinct business activities, and phrases of activities that are taken for them.
ACTIVITIES = {
    "software": (("software", "saas", "software development", "software company", "developer tools", "application development"),
                 ("computer repair", "pc repair", "it support", "tech support", "managed service provider", "managed services", "help desk", "break fix")),
    "marketing": (("marketing", "marketing agency", "advertising", "advertising agency", "digital marketing"), ("print shop", "sign shop")),
    "restaurant": (("restaurant", "restaurants", "diner", "eatery", "cuisine"), ("grocery", "supermarket", "food truck rental")),
    "legal": (("legal", "lawyer", "attorney", "law firm"), ()),
    "healthcare": (("healthcare", "health care", "clinic", "doctor", "hospital", "medical"), ()),
    "finance": (("finance", "financial", "banking"), ()),
    "construction": (("construction", "construction company", "general contractor", "builder"), ("hardware store", "lumber yard")),
    "real-estate": (("real estate", "estate agent", "realty", "realtor"), ()),
    "real-estate-investor": (("real estate investor", "real estate investment", "property investment", "acquisition", "cash home buyer", "fix and flip", "wholesaler", "we buy houses", "house buying"),
                             ("real estate agent", "realtor", "brokerage", "property management", "real estate photographer", "real estate attorney", "real estate lawyer", "mortgage", "real estate software", "real estate agency", "construction company")),
}
#: Words of page furniture and of companies, which are no part of a person's name.
NOT_NAMES = (
    "share", "article", "related", "posts", "search", "menu", "home", "blog", "guide", "click", "subscribe", "newsletter", "privacy", "terms", "login", "about", "contact", "welcome", "services", "company", "team",
    "leadership", "our", "the", "read", "more", "investor", "investors", "realty", "capital", "holdings", "properties", "group", "partners", "ventures", "management", "agency", "solutions", "consulting", "real", "estate", "llc", "inc",
)
#: Parts of a person match and of an entity agreement.
PERSON_PARTS = {"company": 0.35, "title": 0.25, "website": 0.2, "name": 0.2}
ENTITY_PARTS = {"name": 0.4, "website": 0.35, "phone": 0.25}


def _holds(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out |= text.contains(p)
    return out


def category(requested: str, text: Column, name: Column, tagged: Column | None = None) -> tuple[Column, Column]:
    """Verdict and reason for a requested category: support and conflict in the text and the tagged category, the company's name taken out.

    A request of two letters or fewer asks for nothing. Names of two letters or fewer stay in the text.
    """
    term = requested.replace("_", " ").strip().lower()
    if len(term) <= 2:
        return F.lit("MATCH"), F.lit("NO_CATEGORY_REQUESTED")
    groups = [g for g in ACTIVITIES.values() if any(term in p or p in term for p in g[0])]
    low_name = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    tag = F.trim(F.replace(F.coalesce(tagged, F.lit("")), F.lit("_"), F.lit(" "))) if tagged is not None else F.lit("")
    body = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", F.coalesce(text, F.lit("")), tag), r"\s+", " ")))
    body = F.when(F.length(low_name) >= 3, F.replace(body, low_name, F.lit(" "))).otherwise(body)
    support = _holds(body, tuple(p for g in groups for p in g[0]) or (term,))
    conflict = _holds(body, tuple(p for g in groups for p in g[1]))
    by_name = F.lower(F.coalesce(name, F.lit(""))).contains(term)
    verdict = F.when(support & conflict, "NEEDS_REVIEW").when(support, "MATCH").when(conflict, "NO_MATCH").when(by_name, "NEEDS_REVIEW").otherwise("NO_MATCH")
    reason = F.when(support & conflict, "CATEGORY_AMBIGUOUS").when(support, "CATEGORY_EVIDENCE").when(conflict, "CATEGORY_CONFLICT").when(by_name, "CATEGORY_NAME_ONLY").otherwise("CATEGORY_MISMATCH")
    return verdict, reason


#: Words that no exclusion rests on, and families of words that stand for one another.
NO_TOKENS = ("the", "and", "for", "with", "from", "that", "this", "only", "not")
FAMILIES = (("broker", "brokers", "brokerage"), ("agency", "agencies"), ("realtor", "realtors"))


def forms(word: str) -> list[str]:
    """A word, its singular if it looks like a plural, and its family."""
    out = {word}
    if word.endswith("ies") and len(word) > 4:
        out.add(word[:-3] + "y")
    if word.endswith("es") and len(word) > 4:
        out.add(word[:-2])
    if word.endswith("s") and not word.endswith("ss") and len(word) > 3:
        out.add(word[:-1])
    return sorted(out.union(*(f for f in FAMILIES if word in f)))


def exclusion(phrase: str, text: Column, name: Column) -> Column:
    """EXCLUDED if the text has every word of the phrase, AMBIGUOUS if it has some or only the name has them, else CLEAR."""
    corpus, title = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    words = [w for w in re.split("[^a-z0-9]+", phrase.lower()) if len(w) >= 3 and w not in NO_TOKENS] or [phrase.strip().lower()]

    def there(where: Column, word: str, least: int = 0) -> Column:
        known = [re.escape(f) for f in forms(word) if len(f) >= least]
        return where.rlike(rf"(^|[^a-z0-9])({'|'.join(known)})([^a-z0-9]|$)") if known else F.lit(False)

    least = 4 if len(words) == 1 else 0
    every, some = F.lit(True), F.lit(False)
    for w in words:
        every &= there(corpus, w)
        some |= there(corpus, w) | there(title, w, least)
    return F.when(every, "EXCLUDED").when(some, "AMBIGUOUS").otherwise("CLEAR")


def links_person(text: Column, address: Column, person: Column) -> Column:
    """Whether a text names a person (all parts of two letters or more) together with an address that is no shared mailbox."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = F.filter(F.split(F.lower(F.trim(person)), r"\s+"), lambda p: F.length(p) >= 2)
    named = F.when(F.size(parts) >= 1, F.forall(parts, lambda p: F.contains(low, p))).otherwise(False)
    return F.coalesce(low.contains(F.lower(address)) & named & ~is_generic_mailbox(address), F.lit(False))


def ownership(contacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each contact (id, name, email): independent sources that link it to its address; two verify the ownership."""
    joined = contacts.join(evidence.withColumnRenamed("contact_id", "id"), "id", "left")
    key = F.when(links_person(F.col("excerpt"), F.col("email"), F.col("name")), source_key(F.col("source_url"), F.col("provider")))
    return joined.groupBy("id").agg(F.countDistinct(key).alias("sources")).withColumn("verified", F.col("sources") >= 2)


def name_similarity(a: Column, b: Column) -> Column:
    """Words of the first name that the second has (repeats count), by the number of distinct words of both."""
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    x, y = split(a), split(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.filter(x, lambda t: F.array_contains(y, t))) / F.size(F.array_union(x, y)))


def same_person(a: str, b: str) -> tuple[Column, Column]:
    """Confidence, and whether two joined candidates (full_name, company, title, source_url, email) are one person."""
    eq = lambda c: F.coalesce((F.lower(F.col(f"{a}.{c}")) == F.lower(F.col(f"{b}.{c}"))) & (F.col(f"{a}.{c}") != ""), F.lit(False))
    origin = lambda t: F.regexp_extract(F.col(f"{t}.source_url"), "^([a-zA-Z]+://[^/]+)", 1)
    site = (origin(a) == origin(b)) & (origin(a) != "")
    alike = F.least(F.lit(1.0), name_similarity(F.col(f"{a}.full_name"), F.col(f"{b}.full_name")))
    score = sum((F.when(c, PERSON_PARTS[k]).otherwise(0.0) for k, c in (("company", eq("company")), ("title", eq("title")), ("website", site))), F.lit(0.0)) + alike * PERSON_PARTS["name"]
    return F.round(score, 2), eq("full_name") & eq("company") & (eq("title") | site | eq("email"))


def agreement(claims: DataFrame, key: str) -> DataFrame:
    """How far the sources of an entity agree on its name, website and phone: distinct values of each, and a confidence."""
    digits = F.nullif(F.regexp_replace("phone", "[^0-9]", ""), F.lit(""))
    out = claims.groupBy(key).agg(
        F.count("*").alias("claims"), F.countDistinct(F.nullif(F.lower(F.trim("name")), F.lit(""))).alias("names"), F.countDistinct(F.nullif(F.lower("website"), F.lit(""))).alias("websites"), F.countDistinct(digits).alias("phones")
    )
    score = sum((F.when(F.col(f"{k}s") <= 1, w).otherwise(0.0) for k, w in ENTITY_PARTS.items()), F.lit(0.0))
    one = F.col("claims") < 2
    same = one | ((F.col("names") <= 1) & (F.col("websites") <= 1) & (F.col("phones") <= 1))
    return out.withColumn("confidence", F.when(one, 0.6).otherwise(F.round(score, 2))).withColumn("same_entity", same)


def plausible_person(name: Column) -> Column:
    """Two to four capitalised words, none of them page furniture or a company word."""
    parts = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    fits = F.forall(parts, lambda p: p.rlike("^[A-Z][a-z'’-]+$|^[A-Z][a-z]+-[A-Z][a-z]+$"))
    clean = ~F.exists(parts, lambda p: F.lower(p).isin(*NOT_NAMES))
    return F.size(parts).between(2, 4) & fits & clean


def recent(status: Column, retrieved_at: Column, days: int, as_of: Column) -> Column:
    """VERIFIED becomes SUPPORTED once its evidence is older than `days`."""
    old = (F.unix_micros(as_of) - F.unix_micros(retrieved_at.cast("timestamp"))) / 86400e6 > days
    return F.when((status == "VERIFIED") & F.coalesce(old, F.lit(False)), "SUPPORTED").otherwise(status)
