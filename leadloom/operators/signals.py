"""Signals of single fields: syntax checks, which of two signals counts, channels, a person's tie to a company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import is_generic_mailbox
from leadloom.functions.urls import host, registrable_domain
from leadloom.operators.discovery import host_class

#: Words of company names that tell companies apart no better than a legal form.
COMMON_WORDS = ("investments", "investment", "capital", "group", "partners", "properties", "company", "holdings", "inc", "llc", "ltd")
#: Sites whose profiles bear a statement about a person out.
PROFILE_SITES = ("linkedin.com", "crunchbase.com", "bloomberg.com", "reuters.com", "sec.gov", "companieshouse.gov.uk")
#: Paths of pages about a company's people; roles that stand for any; words of a stored tie that count.
TEAM_PATH = r"(?i)/(team|about|leadership|people|staff|our-team|management|founders?)(/|$)"
ANY_ROLE = "(?:CEO|Founder|President|Owner|Director|Partner|Manager|[A-Za-z][A-Za-z\\s-]{1,40})"
PLAIN_TIES = r"(?i)^(current|active|employee|executive)$"
#: What a name after of, at or for looks like, and legal forms that are left off it.
NAMED_AFTER = r"\b(?:of|at|for)\s+([A-Z][\p{L}'’.-]+(?:\s+[A-Z][\p{L}'’.-]+){0,5})"
LEGAL_END = r"(?i)\b(Inc|LLC|Ltd|GmbH|Co)\b\.?"
#: Characters around a person's first mention in which another company's name counts, before and behind.
WINDOW = (80, 200)


def syntax_status(field: Column, value: Column) -> Column:
    """What a value's form alone says: NOT_FOUND, INVALID or UNVERIFIED. Fields are email, phone and website; others are taken as they are."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    readable = F.try_parse_url(value, F.lit("HOST")).isNotNull() & value.rlike("(?i)^https?://")
    wrong = (
        F.when(field == "email", ~value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$")).when(field == "phone", ~digits.between(7, 15))
        .when(field == "website", ~F.coalesce(readable, F.lit(False)) | host_class(host(value)).isNotNull()).otherwise(False)
    )
    return F.when(F.coalesce(value, F.lit("")) == "", "NOT_FOUND").when(wrong, "INVALID").otherwise("UNVERIFIED")


def shared_mailbox(field: Column, value: Column) -> Column:
    """Whether a value is an address of a company and of no person."""
    return F.coalesce((field == "email") & is_generic_mailbox(value), F.lit(False))


def merged_signal(evidence: Column, provider: Column, delivered: Column, kind: Column) -> tuple[Column, Column, Column]:
    """Status, kind and whether mail is delivered, of the signal of stored evidence and that of a provider.

    Evidence that needs review, or that is verified, stands. Else a provider's INVALID stands, and its
    VERIFIED lifts weaker evidence; evidence that supports stands next; then the provider's word. No signal ever says who owns an address.
    """
    firm = evidence.isin("NEEDS_REVIEW", "CONFLICT", "VERIFIED")
    lifted = (provider == "VERIFIED") & evidence.isin("SUPPORTED", "UNVERIFIED", "FOUND")
    status = F.when(firm, evidence).when((provider == "INVALID") | lifted, provider).when(evidence == "SUPPORTED", evidence).otherwise(provider)
    found = (
        F.when(firm, F.when(evidence == "VERIFIED", F.lit("independent_evidence")).otherwise(kind)).when(provider == "INVALID", kind).when(lifted, F.coalesce(kind, F.lit("deliverability")))
        .when(evidence == "SUPPORTED", "evidence_supported").otherwise(kind)
    )
    return status, found, F.when(firm | (provider == "INVALID"), F.coalesce(delivered, F.lit(False))).when(lifted, F.coalesce(delivered, F.lit(True))).otherwise(F.coalesce(delivered, F.lit(False)))


def channel_status(field: Column, value: Column, status: Column, owned: Column, delivered: Column, kind: Column) -> Column:
    """What a contact shows for its e-mail or phone, from the row of the last verification."""
    none = status.isNull() | status.isin("NOT_FOUND", "INVALID") | (F.coalesce(value, F.lit("")) == "")
    plain = F.when(status.isin("SUPPORTED", "FOUND"), status)
    mail = (
        F.when(owned, "PERSON_OWNERSHIP_VERIFIED").when(delivered, "DELIVERABILITY_VERIFIED").when(status == "VERIFIED", "EVIDENCE_VERIFIED").when(status == "SUPPORTED", "SUPPORTED")
        .when(kind == "syntax", "SYNTAX_VALID").when(status == "FOUND", "FOUND").otherwise("UNVERIFIED")
    )
    other = F.when(status == "VERIFIED", "VERIFIED").otherwise(F.coalesce(plain, F.lit("UNVERIFIED")))
    return F.when(none, "NOT_FOUND").when(status.isin("CONFLICT", "NEEDS_REVIEW"), "NEEDS_REVIEW").when(field == "email", mail).otherwise(other)


def literal(value: Column) -> Column:
    """A pattern that matches a value as it stands."""
    return F.regexp_replace(F.trim(value), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def mentions_person(text: Column, person: Column) -> Column:
    """Whether a text has every part of a name, or the name itself if it is a single word."""
    body, name = F.lower(text), F.lower(F.trim(person))
    parts = F.filter(F.split(name, r"\s+"), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts) >= 2, F.forall(parts, lambda p: F.contains(body, p))).otherwise(body.contains(name))


def mentions_company(text: Column, company: Column) -> Column:
    """Whether a text has a company's name, or all its telling words."""
    body, name = F.lower(text), F.lower(F.trim(company))
    words = F.filter(F.split(name, "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON_WORDS))
    return ((F.length(name) >= 3) & body.contains(name)) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(body, w)))


def states_affiliation(text: Column, person: Column, title: Column, company: Column) -> Column:
    """Whether a text says that a person holds a role at a company."""
    body = F.regexp_replace(text, r"\s+", " ")
    who, where = literal(person), literal(company)
    role = F.when(F.trim(F.coalesce(title, F.lit(""))) != "", literal(title)).otherwise(F.lit(ANY_ROLE))
    join = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    pattern = join(
        "(?i)(?:", who, r"(?:[,\s]+(?:the\s+)?|\s+is\s+(?:the\s+)?)", role, r"\s+(?:of|at|for|with)\s+", where, "|", role, r"\s+(?:of|at|for)\s+", where, "|", who, r"[,\s]+", role, r"[,\s]+", where, ")"
    )
    return F.regexp_like(body, pattern)


def names_another_company(text: Column, person: Column, company: Column) -> Column:
    """Whether the text around a person's first mention puts the person at some other company."""
    at = F.position(F.get(F.split(F.lower(F.trim(person)), r"\s+"), 0), F.lower(text))
    window = F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - WINDOW[0]), F.lit(WINDOW[1]) + F.least(F.lit(WINDOW[0]), at - 1))).otherwise(text)
    named = F.trim(F.regexp_replace(F.regexp_extract(window, NAMED_AFTER, 1), LEGAL_END, ""))
    return (F.length(named) >= 3) & ~mentions_company(named, company) & ~mentions_company(company, named)


def relationships(people: DataFrame, evidence: DataFrame) -> DataFrame:
    """How well a person's tie to a company is borne out: id, verdict, reason, and the excerpt and URL that decide.

    People have id, person, title, company, website, relation and relation_status; evidence has id, n (its order), text and url.
    Each kind of support is one minimum over the evidence, so rows of a person need not be gathered.
    """
    joined = people.join(evidence, "id", "left").withColumns({"text": F.coalesce("text", F.lit("")), "url": F.coalesce("url", F.lit(""))})
    c = F.col
    path = F.coalesce(F.try_parse_url(F.when(c("url").contains("://"), c("url")).otherwise(F.concat(F.lit("https://"), c("url"))), F.lit("PATH")), F.lit(""))
    team = (c("url") != "") & path.rlike(TEAM_PATH)
    owned = (c("url") != "") & (F.coalesce(registrable_domain(c("url")) == registrable_domain(c("website")), F.lit(False)) | team)
    profile = F.coalesce(registrable_domain(c("url")).isin(*PROFILE_SITES), F.lit(False))
    # Patterns made of a row's own values cost most: a text that a person has from many pages of one kind is read once, and its first hit stands for all.
    joined = joined.withColumns({"_team": team, "_owned": owned, "_profile": profile}).groupBy(*people.columns, "text", "_team", "_owned", "_profile").agg(F.min(F.when(c("n").isNotNull(), F.struct("n", "url"))).alias("_first"))
    joined = joined.select("*", c("_first.n").alias("n"), c("_first.url").alias("url"))
    team, owned, profile = c("_team"), c("_owned"), c("_profile")
    both = mentions_person(c("text"), c("person")) & mentions_company(c("text"), c("company"))
    stated = states_affiliation(c("text"), c("person"), c("title"), c("company"))
    kinds = {
        "wrong": names_another_company(c("text"), c("person"), c("company")), "strong": both & owned & (stated | team), "supported": both & stated & profile, "weak": both,
    }
    keep = ["person", "company", "relation", "relation_status"]
    hit = F.struct("n", "text", "url")
    marked = joined.select("id", *keep, *(F.when(F.coalesce(f, F.lit(False)) & c("n").isNotNull(), hit).alias(k) for k, f in kinds.items()))
    found = marked.groupBy("id").agg(*(F.first(k).alias(k) for k in keep), *(F.min(k).alias(k) for k in kinds))
    missing = (F.trim(F.coalesce("person", F.lit(""))) == "") | (F.trim(F.coalesce("company", F.lit(""))) == "")
    relation = F.trim(F.coalesce("relation", F.lit("")))
    tie = (relation != "") & (mentions_company(relation, c("company")) | relation.rlike(PLAIN_TIES))
    checked = c("relation_status").isin("VERIFIED", "SUPPORTED")
    none = F.lit(None).cast("struct<n:bigint,text:string,url:string>")
    said = lambda text: F.struct(F.lit(None).cast("bigint").alias("n"), text.alias("text"), F.lit(None).cast("string").alias("url"))
    ladder = [
        (missing, "MISSING", "PERSON_OR_COMPANY_MISSING", none), (c("wrong").isNotNull(), "REJECTED", "WRONG_COMPANY_AFFILIATION", c("wrong")), (c("strong").isNotNull(), "STRONG", "OFFICIAL_COMPANY_RELATIONSHIP_EVIDENCE", c("strong")),
        (c("supported").isNotNull(), "SUPPORTED", "SUPPORTED_RELATIONSHIP_EVIDENCE", c("supported")), (checked & (c("relation_status") == "VERIFIED"), "STRONG", "RELATIONSHIP_FIELD_VERIFIED", said(F.coalesce("relation", "person"))),
        (checked, "SUPPORTED", "RELATIONSHIP_FIELD_VERIFIED", said(F.coalesce("relation", "person"))), (tie, "WEAK", "RELATIONSHIP_STRING_ONLY", said(relation)), (c("weak").isNotNull(), "AMBIGUOUS", "WEAK_SNIPPET_ONLY", c("weak")),
    ]
    verdict, reason, deciding = F.when(F.lit(False), ""), F.when(F.lit(False), ""), F.when(F.lit(False), none)
    for condition, v, r, h in ladder:
        fits = F.coalesce(condition, F.lit(False))
        verdict, reason, deciding = verdict.when(fits, v), reason.when(fits, r), deciding.when(fits, h.cast("struct<n:bigint,text:string,url:string>"))
    return found.select("id", verdict.otherwise("MISSING").alias("verdict"), reason.otherwise("NO_RELATIONSHIP_EVIDENCE").alias("reason"), F.nullif(F.substring(deciding["text"], 1, 160), F.lit("")).alias("excerpt"), F.nullif(deciding["url"], F.lit("")).alias("url"))
