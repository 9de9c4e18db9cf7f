"""Labels for messages, statuses and URLs: ordered rules, the first that fits gives the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.urls import host, same_site

#: What a rejection reason, or the message of a provider, is counted as.
REJECTIONS = (
    ("DUPLICATE", "duplicate"),
    ("WRONG_LOCATION", "wrong_?location|outside_requested_location"),
    ("EXCLUDED_CATEGORY", "exclu"),
    ("WRONG_CATEGORY", "wrong_?category|not_real_estate|^(no_match|category_mismatch|category_conflict)$"),
    ("DIRECTORY_OR_LISTICLE", "listicle|directory|job_board|^(generic_list|review_site|news_article|marketplace|generic_third_party_page)$"),
    ("INVALID_COMPANY_IDENTITY", "invalid_company|unusable_name|invalid_url|^(social_profile|proxy_or_filing)$"),
    ("INSUFFICIENT_COMPANY_EVIDENCE", "insufficient|missing.?evidence"),
    ("PROVIDER_RESULT_INVALID", "provider.?result.?invalid|malformed"),
    ("PROVIDER_QUOTA", "plan limit|pay-as-you-go|quota|http 432|http 433|resource_exhausted"),
    ("PROVIDER_RATE_LIMIT", "rate limit|429"),
)
#: What a failure's message says about it, and which of these kinds a later try may mend.
FAILURES = (
    ("CONFIGURATION_ERROR", r"not configured|openrouter_model|google_places_api_key|authentication failed \(status 40[13]\)|plan limit|pay-as-you-go limit|quota exceeded"),
    ("TRANSIENT_PROVIDER_ERROR", "rate limit|timed out|timeout|econnreset|temporarily unavailable"),
    ("NOT_FOUND", r"\bnot found\b"),
    ("PERMISSION_ERROR", "forbidden|permission"),
    (
        "VALIDATION_ERROR",
        "validation|status 400|status 404|malformed classification|invalid classification|invalid positive evidence|invalid negative evidence|invalid investor type|invalid missing evidence|invalid exclusion reason"
        "|invalid company size|invalid location status",
    ),
)
RETRYABLE = ("TRANSIENT_PROVIDER_ERROR",)
#: What no message to users may show, the longest that is shown, and what stands for the others.
PRIVATE, LONGEST, PLAIN = r"at\s+\S+\s+\(|(?i:postgres|redis:|api[_-]?key|bearer |econn|secret)", 300, "Pipeline stage failed."
#: Words of a page failure that another try will not mend.
PERMANENT = ("robots", "401", "403", "404", "unsupported content", "blocked")
#: Paths of pages that tell about people and the company.
PAGE_KINDS = (("WEBSITE_TEAM_PAGE", r"/(team|our-team|leadership|management)\b"), ("WEBSITE_ABOUT_PAGE", r"/(about|about-us|company)\b"), ("WEBSITE_CONTACT_PAGE", r"/contact\b"))
#: Other names of investor types, and the types.
INVESTOR_ALIASES = {
    "COMMERCIAL_REAL_ESTATE_INVESTOR": "COMMERCIAL_INVESTOR", "RESIDENTIAL_REAL_ESTATE_INVESTOR": "REAL_ESTATE_INVESTOR_OTHER", "REAL_ESTATE_INVESTOR": "REAL_ESTATE_INVESTOR_OTHER", "OTHER_INVESTOR": "REAL_ESTATE_INVESTOR_OTHER",
    "OTHER_REAL_ESTATE_INVESTOR": "REAL_ESTATE_INVESTOR_OTHER", "MIXED": "REAL_ESTATE_INVESTOR_OTHER", "MIXED_INVESTMENT_STRATEGIES": "REAL_ESTATE_INVESTOR_OTHER", "MULTIPLE_INVESTMENT_STRATEGIES": "REAL_ESTATE_INVESTOR_OTHER",
    "MULTI_FAMILY_INVESTOR": "MULTIFAMILY_INVESTOR", "UNKNOWN": "NOT_DETERMINED", "NOT_FOUND": "NOT_DETERMINED", "NA": "NOT_DETERMINED", "N_A": "NOT_DETERMINED", "NONE": "NOT_DETERMINED", "NULL": "NOT_DETERMINED",
}
#: Provider words for an address that does not exist, and for one that may.
NO_MAIL, SOME_MAIL = "invalid|not.?found|red", "valid|green|unknown|catch.?all|verified"
#: Legal forms that names of one company may differ by, and path words that are no company's name on a social site.
COMPANY_FORMS = "inc|llc|ltd|gmbh|co|company"
NO_ACCOUNTS = ("share", "sharer", "login", "search", "intent", "explore", "watch", "people", "groups", "status", "posts", "p", "reel")


def first_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first rule whose pattern a text has, whatever the case; null if there is none."""
    out = F.when(text.isNull(), None)
    for label, pattern in rules:
        out = out.when(text.rlike(f"(?i){pattern}"), label)
    return out


def rejection(reason: Column) -> Column:
    """The kind of a rejection reason."""
    return F.coalesce(first_rule(F.trim(reason), REJECTIONS), F.lit("OTHER"))


def stop_reason(accepted: Column, cap: Column, issued: Column, budget: Column, error: Column, low_yield: Column, all_down: Column) -> Column:
    """Why a discovery ended."""
    kind = rejection(error)
    return (
        F.when((accepted >= cap) & (cap > 0), "ACCEPTANCE_CAP_REACHED").when(all_down, "ALL_PROVIDERS_EXHAUSTED").when(kind.isin("PROVIDER_QUOTA", "PROVIDER_RATE_LIMIT"), kind)
        .when(error.rlike("(?i)location resolution"), "LOCATION_RESOLUTION_FAILED").when(F.coalesce(error, F.lit("")) != "", "PROVIDER_UNAVAILABLE")
        .when((issued >= budget) & (budget > 0), "QUERY_BUDGET_EXHAUSTED").when(low_yield, "LOW_YIELD_EXHAUSTED").otherwise("INSUFFICIENT_VALID_CANDIDATES")
    )


def shown_message(message: Column) -> Column:
    """The first line of a message if users may see it."""
    first = F.trim(F.substring_index(F.coalesce(message, F.lit("")), "\n", 1))
    return F.when((first == "") | (F.length(first) > LONGEST) | first.rlike(PRIVATE), PLAIN).otherwise(first)


def failure(message: Column) -> tuple[Column, Column, Column]:
    """Code, message for users, and whether another try may help."""
    code = first_rule(F.coalesce(message, F.lit("")), FAILURES)
    return F.coalesce(code, F.lit("INTERNAL_ERROR")), F.when(code.isNull(), PLAIN).otherwise(shown_message(message)), F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def page_failure(message: Column) -> Column:
    """Whether a page may be tried again."""
    return F.when(F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(PERMANENT)), "PERMANENT").otherwise("TRANSIENT")


def page_kind(url: Column) -> Column:
    """What a page of a company's site is evidence of, by its path."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), url))
    return F.coalesce(first_rule(path, PAGE_KINDS), F.lit("COMPANY_WEBSITE"))


def investor_type(value: Column, types: Sequence[str]) -> tuple[Column, Column]:
    """The canonical type of a value, null if it has none, and whether it is to be rejected."""
    key = F.regexp_replace(F.regexp_replace(F.replace(F.upper(F.trim(value)), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    stem = F.regexp_replace(key, "_INVESTOR$", "")
    aliases = F.create_map(*(F.lit(x) for pair in INVESTOR_ALIASES.items() for x in pair))
    out = F.when(F.coalesce(key, F.lit("")) == "", "NOT_DETERMINED").when(key.isin(*types), key).when(stem.isin(*types), stem).otherwise(F.element_at(aliases, key))
    return out, out.isNull()


def contact_state(status: Column) -> Column:
    """A contact's state from the verification status of its identity."""
    return F.when(status == "VERIFIED", "VERIFIED").when(status == "SUPPORTED", "PARTIALLY_VERIFIED").when(status.isin("CONFLICT", "NEEDS_REVIEW"), "NOT_VERIFIED").when(status == "NOT_FOUND", "NOT_FOUND").otherwise("DISCOVERED")


def provider_mail_status(status: Column) -> Column:
    """What a provider's word for an address says: never that it is a person's own."""
    known = F.coalesce(status, F.lit(""))
    return F.when(known == "", "UNVERIFIED").when(known.rlike(f"(?i){NO_MAIL}"), "NOT_FOUND").when(known.rlike(f"(?i){SOME_MAIL}"), "FOUND").otherwise("UNVERIFIED")


def mail_of_domain(email: Column, domain: Column) -> Column:
    """Whether an address is at a domain or under it."""
    at, site = F.lower(F.get(F.split(email, "@"), 1)), F.regexp_replace(F.lower(domain), r"^www\.", "")
    return F.coalesce((at != "") & ((at == site) | at.endswith(F.concat(F.lit("."), site))), F.lit(False))


def names_compatible(a: Column, b: Column) -> Column:
    """Whether two names may be one company's: equal or one within the other, legal forms apart."""
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), rf"\b({COMPANY_FORMS})\b\.?", ""), "[^a-z0-9]+", " "))
    x, y = tidy(a), tidy(b)
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


def loose_company_social(url: Column) -> Column:
    """Whether a social URL of one path word may be a company's account."""
    name = host(url)
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    word = F.get(parts, 0)
    known = name.rlike("(facebook|instagram|twitter|x)\\.com$") & ~F.lower(word).isin(*NO_ACCOUNTS)
    tube = (name.endswith("youtube.com") | (name == "youtu.be")) & word.startswith("@")
    return F.coalesce((F.size(parts) == 1) & (tube | known), F.lit(False))


def size_source(url: Column, website: Column, text: Column, host_kind: Column) -> Column:
    """Where an employee size comes from; `host_kind` is the class of the URL's host."""
    own = F.coalesce(same_site(url, website), F.lit(False))
    return F.when(own, "official_company").when(host_kind == "DIRECTORY", "public_directory").when(text.rlike("(?i)company profile|business profile"), "public_company_profile").otherwise("other_public")
