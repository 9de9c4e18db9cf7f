"""Pages of companies as facts, evidence rows and people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.functions.text import title_role
from leadloom.functions.urls import host, social_url
from leadloom.operators.verdicts import plausible_person

#: Mailboxes that a company gives to the public.
PUBLIC_MAILBOXES = ("info", "contact", "hello", "support", "sales", "team", "press", "careers")
#: Phrases of investors' pages.
INVESTMENT_PHRASES = (
    "we buy houses? for cash", "buy and hold", "fix and flip", "brrrrr", "distressed properties?", "commercial property acquisition", "land acquisition", "we purchase distressed properties?",
)
#: Headings of what a company offers, where and in what; characters that are taken from a heading on.
SECTIONS = {"services": ("services", "solutions", "what we do"), "markets_served": ("markets served", "areas served", "geographies"), "property_types": ("property types", "properties", "portfolio")}
SECTION_CHARS = 220
#: Words in front of a name that are no part of it, for page windows and for sentences.
NAME_FILLERS = ("about", "our", "the", "team", "leadership", "contact", "home", "welcome", "services", "industries", "company", "page", "share", "article", "related", "posts", "search", "menu")
SENTENCE_FILLERS = ("About", "The", "Our", "Home", "Contact", "Email")
#: Managers of one kind, whose title stays whole.
MANAGERS = ("office", "project", "account", "product", "marketing", "sales", "hiring", "property", "community", "store", "branch", "district", "regional", "assistant", "general", "operations", "program", "portfolio")
#: Characters before and behind a name in which a title counts, and around a link in which a name counts.
BEFORE, BEHIND, AROUND = 120, 180, 300

_MAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_PHONE = r"(?:\+?1[-.\s]?)?(?:\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4})"
_SPACED_PHONE = r"(?:\+?[0-9]{1,3}[-.\s])?(?:\(?[0-9]{3}\)?[-.\s])[0-9]{3}[-.\s][0-9]{4}"
_STREET = r"(?i)[0-9]+\s+[A-Za-z0-9.#\- ]+,?\s+[A-Za-z0-9.#\- ]+,?\s+[A-Za-z]{2,}\s+[0-9]{5}"
_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}"
_SENTENCE = r"(?<=[.!?])\s+"


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def public_email(text: Column) -> Column:
    """The first address in a text that a company gives to the public."""
    local = lambda a: F.substring_index(a, "@", 1)
    found = F.transform(F.regexp_extract_all(text, F.lit(_MAIL), F.lit(0)), F.lower)
    return F.get(F.filter(found, lambda a: local(a).rlike(rf"^({'|'.join(PUBLIC_MAILBOXES)})($|[.+])")), 0)


def first_phone(text: Column) -> Column:
    """The first phone number of ten digits, with or without the country's 1."""
    return F.nullif(_flat(F.regexp_extract(text, _PHONE, 0)), F.lit(""))


def first_spaced_phone(text: Column) -> Column:
    """The first phone number whose groups are set apart."""
    return F.nullif(F.trim(F.regexp_extract(text, _SPACED_PHONE, 0)), F.lit(""))


def street_address(text: Column, html: Column) -> Column:
    """The street of structured data, else the first run of words that looks like an address."""
    structured = _flat(F.regexp_extract(html, r'(?is)"address"\s*:\s*\{.*?"streetAddress"\s*:\s*"([^"]+)"', 1))
    return F.coalesce(F.nullif(structured, F.lit("")), F.nullif(_flat(F.regexp_extract(text, _STREET, 0)), F.lit("")))


def investment_phrases(text: Column) -> Column:
    """The investors' phrases in a text, as they stand, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in INVESTMENT_PHRASES))))


def section(text: Column, headings: Sequence[str]) -> Column:
    """What follows each heading that a text has."""

    def after(heading: str) -> Column:
        at = F.locate(heading, F.lower(text))
        found = F.regexp_replace(_flat(F.substring(text, at, F.lit(SECTION_CHARS))), f"(?i)^{heading}", "")
        return F.when(at > 0, F.nullif(F.trim(found), F.lit("")))

    return F.array_compact(F.array(*map(after, headings)))


def description(text: Column, html: Column) -> Column:
    """The page's own description, else its first two sentences, 300 characters at most."""
    sentences = F.filter(F.split(text, _SENTENCE), lambda s: s != "")
    return F.coalesce(H.meta_description(html), F.nullif(F.substring(F.array_join(F.slice(sentences, 1, 2), " "), 1, 300), F.lit("")))


def page_facts(pages: DataFrame) -> DataFrame:
    """`pages` (url, html and more) with their text and one struct of facts."""
    rows = pages.withColumn("text", H.visible_text(F.col("html")))
    text, html = F.col("text"), F.col("html")
    links = F.array_distinct(F.filter(F.transform(H.hrefs(html), social_url), lambda u: H.social_platform(host(u)).isNotNull()))
    signals = investment_phrases(text)
    facts = F.struct(
        H.title(html).alias("company_name"), description(text, html).alias("description"), first_phone(text).alias("phone"), public_email(F.concat_ws("\n", text, html)).alias("public_email"), street_address(text, html).alias("address"),
        links.alias("social_links"), signals.alias("investment_signals"), F.get(signals, 0).alias("investment_strategy"), *(section(text, names).alias(k) for k, names in SECTIONS.items()),
    )
    return rows.withColumn("facts", facts)


def evidence_rows(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row of evidence for each of a page's description, e-mail address and phone number."""
    row = lambda field, kind, column: F.struct(F.lit(field).alias("field"), F.col(f"facts.{column}").alias("value"), F.lit(kind).alias("evidence_type"))
    each = F.array(row("description", "WEBSITE", "description"), row("publicEmail", "CONTACT_PAGE", "public_email"), row("phone", "CONTACT_PAGE", "phone"))
    return facts.select(*keys, "url", F.explode(F.filter(each, lambda e: e["value"].isNotNull())).alias("e")).select(*keys, "e.field", "e.value", F.col("url").alias("source_url"), F.substring("e.value", 1, 300).alias("excerpt"), "e.evidence_type")


def fill_empty(companies: DataFrame, facts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Companies (id and more) whose empty columns are filled from their pages (company_id, n, facts): the first page that has a value wins."""
    picks = [F.min_by(F.col(f"facts.{source}"), F.when(F.col(f"facts.{source}").isNotNull(), F.col("n"))).alias(f"_{c}") for c, source in columns.items()]
    found = facts.groupBy(F.col("company_id").alias("id")).agg(*picks)
    filled = companies.join(found, "id", "left")
    return filled.select(*(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in companies.columns))


def clean_name(name: Column) -> Column:
    """A name without the page's words in front of it; the name as it was if nothing is left."""
    flat = _flat(name)
    rest = F.regexp_replace(flat, rf"(?i)^(?:(?:{'|'.join(NAME_FILLERS)})(?:\s+|$))+", "")
    return F.when(rest == "", flat).otherwise(rest)


def stated_title(text: Column) -> Column:
    """The title that a text states: a manager of one kind whole, else the role of its words."""
    manager = F.initcap(F.lower(_flat(F.regexp_extract(text, rf"(?i)\b((?:{'|'.join(MANAGERS)})\s+manager)\b", 1))))
    return F.coalesce(F.nullif(manager, F.lit("")), title_role(F.nullif(F.regexp_extract(text, r"(?i)\b(co-?founder|founder|chief executive officer|ceo|president|owner|managing partner|managing director|partner|director|principal|manager)\b", 1), F.lit(""))))


def people_in_windows(pages: DataFrame, roles: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, full_name, title): plausible names in `text`, with each wanted role that stands around the first mention; null without one."""
    names = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("text", F.lit(_NAME), F.lit(0)), clean_name), plausible_person))
    each = pages.select(*keys, "text", F.explode(names).alias("full_name"))
    at = F.position(F.lower("full_name"), F.lower("text"))
    before = F.substring("text", F.greatest(F.lit(1), at - BEFORE), F.least(F.lit(BEFORE), at - 1))
    behind = F.substring("text", at + F.length("full_name"), F.lit(BEHIND))
    around = F.lower(F.concat(before, F.lit(" "), behind))
    wanted = F.array(*(F.lit(r.strip().upper().replace(" ", "_")) for r in roles))
    spoken = lambda r: F.lower(F.replace(r, F.lit("_"), F.lit(" ")))
    found = F.filter(wanted, lambda r: F.contains(F.col("around"), spoken(r)) | F.contains(F.col("around"), F.lower(F.replace(r, F.lit("_"), F.lit("")))))
    return each.withColumn("around", around).select(*keys, "full_name", F.explode_outer(found).alias("role")).select(*keys, "full_name", title_role(F.replace("role", F.lit("_"), F.lit(" "))).alias("title"))


def people_in_sentences(pages: DataFrame, roles: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, name, title, excerpt): in each sentence of `text` the first name, with the longest wanted role; a name and role once for each key."""
    sentences = pages.select(*keys, F.posexplode(F.split("text", _SENTENCE)).alias("n", "sentence"))
    low = F.lower("sentence")
    ordered = sorted(roles, key=len, reverse=True)
    role = F.when(F.lit(False), "")
    for r in ordered:
        role = role.when(low.contains(r.lower().replace("_", " ")) | low.contains(r.lower().replace("_", "-")), r)
    words = F.split(F.regexp_extract("sentence", rf"\b({_NAME})\b", 1), r"\s+")
    kept = F.split(F.regexp_replace(F.array_join(words, " "), rf"^(?:(?:{'|'.join(SENTENCE_FILLERS)})(?: |$))+", ""), " ")
    name = F.when(F.size(kept) >= 2, F.array_join(F.slice(kept, 1, 3), " "))
    found = sentences.select(*keys, "n", F.trim("sentence").alias("excerpt"), role.alias("role"), name.alias("name")).filter("role IS NOT NULL AND name IS NOT NULL")
    first = found.groupBy(*keys, F.lower("name").alias("low"), "role").agg(F.min(F.struct("n", "name", "excerpt")).alias("f"))
    return first.select(*keys, "f.name", F.replace("role", F.lit("_"), F.lit(" ")).alias("title"), "f.excerpt")


def merge_people(people: DataFrame, keys: Sequence[str]) -> DataFrame:
    """People of several pages (name, title, url) by name and title: how many pages name them, and the first; the pages stay rows of `people`."""
    merged = people.groupBy(*keys, F.lower("name").alias("person"), F.lower(F.coalesce("title", F.lit(""))).alias("role"))
    return merged.agg(F.min("name").alias("name"), F.min("title").alias("title"), F.countDistinct("url").alias("n_pages"), F.min("url").alias("first_page")).drop("person", "role")


def profile_links(pages: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, url): links to a person's profile that stand within AROUND characters of the name; `names` has keys and name."""
    # Each link with what is around it: the text is cut at the links, so that every link is seen.
    link = rf"(?is)(.{{0,{AROUND}}})href=[\"']([^\"']+)[\"'](?=(.{{0,{AROUND}}}))"
    both = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(link), F.lit(k)).alias(n) for k, n in ((1, "before"), (2, "target"), (3, "behind"))))
    each = pages.select(*keys, "url", F.explode(both).alias("l"))
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.concat("l.before", F.lit(" "), "l.behind"), "<[^>]*>?", " "), r"\s+", " "))
    target = H.resolve(F.col("l.target"), F.col("url"))
    found = each.select(*keys, plain.alias("around"), social_url(target).alias("profile")).filter(F.col("profile").rlike(r"(?i)linkedin\.com/in/|facebook\.com/[^/]+$|instagram\.com/[^/]+$|(twitter|x)\.com/[^/]+$"))
    return found.join(names, list(keys)).filter(F.contains(F.col("around"), F.lower("name"))).select(*keys, "name", F.col("profile").alias("url")).distinct()
