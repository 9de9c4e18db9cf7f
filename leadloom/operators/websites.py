"""Is a page a company's own site? Identity of names, domains, titles and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.urls import host
from leadloom.operators.discovery import host_class

#: Legal forms, words that qualify a name, words that are no name, and titles that are no brand.
LEGAL_WORDS = ("llc", "inc", "incorporated", "corp", "corporation", "co", "ltd", "limited", "company", "lp", "llp", "pllc", "plc")
QUALIFIERS = (
    "investments", "investors", "investment", "capital", "holdings", "partners", "partner", "properties", "property", "realty", "ventures", "equity", "advisors", "advisor", "management", "fund", "funds", "trust", "group",
)
FILLERS = ("and", "the", "for")
GENERIC_TITLES = ("home", "homepage", "welcome", "official", "official site", "official website", "about", "about us", "contact", "contact us")
#: Phrases of directories and of filings, and paths of news.
DIRECTORY_PHRASES = r"(?i)company profile|business profile|business directory|funding,?\s+team|team\s*&\s*investors|investor profile|startup profile|companies like|view all companies|listed companies"
FILING_PHRASES = r"(?i)definitive proxy|proxy statement|schedule 14a|form 10-k|form 10-q|proxy voting|securities and exchange commission"
NEWS_PATH = r"(?i)/(news|article|articles|press|stories)\b|/20[0-9]{2}/[0-9]{2}/"
#: Points of a full name, of a supported brand, of a name at the beginning, of an own domain, of the place and of a contact.
FULL_NAME, BRAND, LEADING, OWN_DOMAIN, PLACE, CONTACT = 20, 12, 4, 8, 4, 2

_TITLE_BREAK = r"\s+[|–—]\s+|\s+-\s+"
_SUBJECT = r"([A-Z][A-Za-z0-9&.'’ -]{2,80}?)\s+is\s+(?:an?\b|the\b)"
_PHONE_OR_MAIL = r"(?i)\b[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4}\b|@[a-z0-9.-]+\.[a-z]{2,}"


def plain(text: Column) -> Column:
    """Lower-case letters and digits with one blank between words; null as empty."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&amp;"), F.lit(" and ")), "[^a-z0-9]+", " "))


def telling(name: Column) -> Column:
    """The words of a name that tell companies apart."""
    return F.filter(F.split(plain(name), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*LEGAL_WORDS, *FILLERS, *QUALIFIERS))


def qualifying(name: Column) -> Column:
    """The words of a name that say what kind of company it is."""
    return F.filter(F.split(plain(name), " "), lambda w: w.isin(*QUALIFIERS))


def different_entity(target: Column, candidate: Column) -> Column:
    """Whether a name shares a telling word with the target but belongs to another: it has others, or other qualifiers."""
    own, other, kind, other_kind = telling(target), telling(candidate), qualifying(target), qualifying(candidate)
    apart = F.size(F.array_except(other, own)) > 0
    kinds = (F.size(kind) > 0) & (F.size(other_kind) > 0) & ~F.arrays_overlap(kind, other_kind)
    return (F.size(other) > 0) & F.coalesce(F.arrays_overlap(own, other), F.lit(False)) & (apart | kinds)


def domain_label(name: Column) -> Column:
    """The label of a host that names its owner, letters and digits alone."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(name), r"^www\.", ""), r"\."), lambda p: p != "")
    n = F.size(parts)
    at = F.when((n >= 3) & (F.length(F.get(parts, n - 2)) <= 3), n - 3).when(n >= 2, n - 2).otherwise(0)
    return F.regexp_replace(F.coalesce(F.get(parts, at), F.lit("")), "[^a-z0-9]", "")


def foreign_qualifier(name: Column, company: Column) -> Column:
    """Whether a host has a qualifier that the company's name does not have."""
    label, own = domain_label(name), qualifying(company)
    return F.exists(F.array(*map(F.lit, QUALIFIERS)), lambda q: ~F.array_contains(own, q) & F.contains(label, q))


def domain_supports(name: Column, company: Column) -> Column:
    """Whether a host has all telling words of the company's name and no qualifier of another."""
    label = domain_label(name)
    return F.forall(telling(company), lambda w: F.contains(label, w)) & ~foreign_qualifier(name, company)


def site_brand(title: Column) -> Column:
    """The last part of a title of several parts."""
    parts = F.filter(F.transform(F.split(title, _TITLE_BREAK), F.trim), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def title_subject(title: Column) -> Column:
    """What a title's first part is about; empty if that is a directory's phrase or no name."""
    subject = F.trim(F.get(F.split(F.get(F.split(title, _TITLE_BREAK), 0), ":"), 0))
    return F.when(subject.rlike(DIRECTORY_PHRASES) | plain(subject).isin(*GENERIC_TITLES), "").otherwise(subject)


def lead_subject(text: Column, company: Column) -> Column:
    """The subject of the first "X is a", if it shares a telling word with the company."""
    found = F.trim(F.regexp_extract(F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), 1, 800), _SUBJECT, 1))
    return F.when((found != "") & F.coalesce(F.arrays_overlap(telling(found), telling(company)), F.lit(False)), found)


def first_heading(html: Column) -> Column:
    inner = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]+>", " "), r"\s+", " "))


def schema_name(html: Column) -> Column:
    """The name of the organisation in a page's structured data."""
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r'(?is)"@type"\s*:\s*"(?:Organization|LocalBusiness|Corporation)".{0,500}?"name"\s*:\s*"([^"]+)"', 1))


def brand_fits(brand: Column, company: Column, city: Column, state: Column) -> Column:
    """Whether a site's brand is no name, the place, or the company's."""
    name, own = plain(brand), plain(company)
    place = F.filter(F.array(F.lower(F.trim(city)), F.lower(F.trim(state))), lambda p: p.isNotNull() & (p != ""))
    return (
        (name == "") | name.isin(*GENERIC_TITLES) | F.exists(place, lambda p: F.contains(name, p)) | own.contains(name) | name.contains(own)
        | F.exists(telling(company), lambda w: F.contains(name, w)) | F.array_contains(qualifying(company), name)
    )


def official_websites(pages: DataFrame) -> DataFrame:
    """`pages` with reason (OFFICIAL_WEBSITE or why not), accepted and score; they have company, city, state, url, title, text and html.

    Each test is a column of its own before the ladder reads it, so that no part of a page is parsed twice.
    """
    c = F.col
    tidy = lambda x: F.trim(F.coalesce(x, F.lit("")))
    rows = pages.withColumns({"_name": tidy(c("company")), "_title": tidy(c("title")), "_host": F.when(c("url").contains("://"), host(tidy(c("url"))))})
    rows = rows.withColumns(
        {
            "_text": F.trim(F.regexp_replace(F.concat_ws(" ", "_title", F.coalesce("text", F.lit(""))), r"\s+", " ")), "_plain": plain(c("_name")), "_telling": telling(c("_name")), "_kinds": qualifying(c("_name")),
            "_lead": lead_subject(c("text"), c("_name")), "_subject": title_subject(c("_title")), "_own": c("_host").isNotNull() & domain_supports(c("_host"), c("_name")), "_brand": site_brand(c("_title")),
            "_body": plain(c("text")), "_page": plain(c("_title")),
        }
    )
    third = c("_host").isNotNull() & ~c("_own")
    rows = rows.withColumn("_identity", F.array(c("_page"), plain(first_heading(c("html"))), plain(schema_name(c("html")))))
    phrase = F.array_join("_telling", " ")
    place = F.filter(F.array(F.lower(F.trim("city")), F.lower(F.trim("state"))), lambda p: p.isNotNull() & (p != ""))
    rows = rows.withColumns(
        {
            "_full": F.exists("_identity", lambda x: F.contains(x, c("_plain"))) | F.contains(plain(c("_lead")), c("_plain")),
            "_placed": F.exists(place, lambda p: F.contains(F.lower(c("_text")), p)), "_contact": c("_text").rlike(_PHONE_OR_MAIL),
            "_phrase": F.exists("_identity", lambda x: F.contains(x, phrase)) | F.contains(c("_body"), F.concat(phrase, F.lit(" is "))),
            "_other": F.exists("_identity", lambda x: (x != "") & different_entity(c("_name"), x)),
        }
    )
    supported = c("_phrase") & ~c("_other") & (c("_own") | c("_placed") | c("_contact") | c("_body").contains(c("_plain")))
    label = domain_label(c("_host"))
    short = (
        (F.size("_telling") < 2) & ~c("_full") & c("_own") & F.exists("_kinds", lambda q: F.contains(label, q)) & F.forall("_telling", lambda w: F.contains(c("_page"), w)) & c("_lead").isNull()
    )
    in_title = c("_page").contains(c("_plain"))
    reason = (
        F.when(host_class(c("_host")).isNotNull(), host_class(c("_host"))).when(F.size("_telling") == 0, "INSUFFICIENT_COMPANY_MATCH")
        .when(c("_lead").isNotNull() & different_entity(c("_name"), c("_lead")) & ~c("_own"), "DIFFERENT_COMPANY")
        .when((c("_subject") != "") & different_entity(c("_name"), c("_subject")) & ~in_title, "DIFFERENT_COMPANY")
        .when(c("_host").isNotNull() & foreign_qualifier(c("_host"), c("_name")) & ~in_title, "DIFFERENT_COMPANY")
        .when(third & c("_text").rlike(FILING_PHRASES), "PROXY_OR_FILING").when(third & c("_text").rlike(DIRECTORY_PHRASES), "DIRECTORY")
        .when(third & F.coalesce(F.try_parse_url(F.trim("url"), F.lit("PATH")), F.lit("")).rlike(NEWS_PATH), "NEWS_ARTICLE")
        .when(third & c("_brand").isNotNull() & ~brand_fits(c("_brand"), c("_name"), c("city"), c("state")), "GENERIC_THIRD_PARTY_PAGE")
        .when((F.size("_telling") < 2) & ~c("_full") & ~short, "INSUFFICIENT_COMPANY_MATCH").when(~c("_full") & ~supported & ~short, "INSUFFICIENT_COMPANY_MATCH").otherwise("OFFICIAL_WEBSITE")
    )
    start = F.substring("_plain", 1, 12)
    leading = F.exists("_identity", lambda x: F.contains(x, c("_plain")) & F.startswith(x, start))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    score = F.when(c("_full"), FULL_NAME).otherwise(BRAND) + points(leading, LEADING) + points(c("_own"), OWN_DOMAIN) + points(c("_placed"), PLACE) + points(c("_contact"), CONTACT)
    judged = rows.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "OFFICIAL_WEBSITE").withColumn("score", F.when(F.col("accepted"), score).otherwise(0))
    return judged.select(*pages.columns, "reason", "accepted", "score")


def best_website(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's pages (with n, their order, and known, whether the site was known before) the one to take: the first
    accepted known one, else the accepted one with the best score, the first of equal ones."""
    rank = F.struct((~F.col("known")).alias("k"), F.when(F.col("known"), 0).otherwise(-F.col("score")).alias("s"), "n")
    return judged.filter("accepted").groupBy(*keys).agg(F.min_by(F.struct("url", "score"), rank).alias("best")).select(*keys, "best.url", "best.score")
