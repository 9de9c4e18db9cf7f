"""Web hits as candidates: name, place, category, exclusions; accepted or the reason why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.labels import NO_ACCOUNTS
from leadloom.functions.urls import host, social_url
from leadloom.operators import verdicts
from leadloom.operators.discovery import first_wins, identity_keys, reject_url
from leadloom.operators.places import COUNTRIES, STATES, country_code
from leadloom.operators.settle import settled
from leadloom.operators.websites import FILLERS, LEGAL_WORDS, plain

#: Hosts of job boards; words of lists; titles that are no name; titles of articles.
JOB_BOARDS = ("indeed.com", "ziprecruiter.com", "monster.com", "simplyhired.com", "careerbuilder.com")
LISTS = r"(?i)\b(top\s+[0-9]+|best\s+[0-9]+|list of|companies to watch|ranking of|directory of|reviewed on|agencies? (?:in|for)|freelancers? (?:in|for))\b"
NO_NAMES = r"(?i)^(home|about|contact|linkedin|facebook|instagram|youtube|twitter|news|blog)$"
ARTICLES = r"(?i)\b(how to|what is|why |guide to|tips for|answered|quora|best agencies|top agencies)\b"
#: Words of other trades, of real estate, and of investors.
OTHER_TRADES = r"(?i)\b(restaurant|dentist|church|school|hotel|cafe|bar & grill|auto repair|salon)\b"
REAL_ESTATE = r"(?i)\b(real[\s-]?estate|realty|propert(?:y|ies)|acquisition|multifamily|apartment buildings?|wholesal(?:e|er|ing)|cash\s+home\s+buy|fix(?:\s|-)?and(?:\s|-)?flip)\b"
INVESTORS = r"(?i)\binvestors?|investments?|acquisition|holdings|multifamily|wholesal(?:e|er|ing)|cash\s+home\s+buy|fix(?:\s|-)?and(?:\s|-)?flip|we\s+buy\s+houses?|house\s+flippers?\b"
#: What texts say of special kinds of investors, by words of the kinds.
KIND_SIGNS = (
    ("cash_home_buyer|cash_buyer", r"(?i)\b(?:cash\s+(?:home|house)\s+buyers?|we\s+buy\s+houses?|buy(?:ing)?\s+houses?\s+for\s+cash)\b"), ("fix_and_flip|house_flipper|flipper", r"(?i)\b(?:fix(?:\s|-)?and(?:\s|-)?flip|house\s+flippers?|flipping\s+houses?)\b"),
    ("wholesaler|wholesal", r"(?i)\b(?:real\s+estate\s+wholesal(?:er|ing)|wholesal(?:e|ing)\s+(?:houses?|homes?|properties|real\s+estate))\b"),
)
INVESTOR_KINDS = "real_estate_investor|house_flipper|fix_and_flip|buy_and_hold|brrrr|land_investor|commercial_real_estate_investor|cash_home_buyer|wholesaler"
#: Names and categories that are no investor's, and words of investors' names.
NO_INVESTOR_NAMES = r"(?i)\b(real estate agents?|realtors?|realty|brokerages?|brokers?|mortgage|title compan(?:y|ies)|insurance|property management|apartment leasing|leasing office|directory)\b"
NO_INVESTOR_CATEGORIES = "(?i)estate agent|property management|insurance|mortgage"
INVESTOR_NAMES = r"(?i)\b(investors?|investments?|acquisitions?|holdings|wholesalers?)\b|\bbuy and hold\b|\bfix and flip\b|\bcash home buy|\bwe buy houses?\b"
#: What speaks for a special lead type, by words of the types, and for investors at large.
SPECIALIZATIONS = (
    ("cash_home_buyer|house_buyer", r"(?i)\bcash\s+(?:home|house)\s+buy|\bwe\s+buy\s+houses?\b|\bhouse\s+buying\b|\bcash\s+offer\b"), ("fix_and_flip|house_flipper", r"(?i)\bfix(?:\s|-)?and(?:\s|-)?flip\b|\bhouse\s+flip|\bflip(?:ping)?\s+(?:houses?|homes?|properties)\b"),
    ("wholesaler|wholesaling", r"(?i)\bwholesal(?:e|er|ing)\b|\boff[\s-]?market\b|\bassignment\s+(?:of\s+)?contract\b"), ("buy_and_hold|brrrr", r"(?i)\bbuy(?:\s|-)?and(?:\s|-)?hold\b|\bbrrrr?\b|\brental\s+(?:property\s+)?acquisitions?\b"),
    ("commercial_real_estate_investor|land_investor", r"(?i)\bcommercial\s+(?:real\s+estate|property|acquisitions?)\b|\bland\s+(?:invest|acqui)"),
)


def name_from_title(title: Column) -> Column:
    """The first part of a title that may be a company's name."""
    parts = F.transform(F.split(title, r"\s+[|–—]\s+|\s+-\s+"), F.trim)
    return F.get(F.filter(parts, lambda p: F.length(p).between(3, 80) & ~p.rlike(NO_NAMES) & ~p.rlike(LISTS) & ~p.rlike(ARTICLES)), 0)


def name_from_url(url: Column) -> Column:
    """The first label of a host as a name."""
    return F.nullif(F.initcap(F.trim(F.regexp_replace(F.substring_index(host(url), ".", 1), "[-_]+", " "))), F.lit(""))


def place_words(city: str | None, state: str | None, country: str | None) -> list[str]:
    """The names and codes that mention a place, in the order in which they count."""
    out = [x.strip() for x in (city, state, country) if x and x.strip()]
    if country == "US" and state:
        out += [code.upper() for code, name in STATES.items() if name == state.strip().lower()]
    known = {"germany": ["Deutschland"], "united arab emirates": ["UAE"], "united kingdom": ["UK"]}
    out += known.get((country or "").lower(), [])
    return out + (["United States", "USA"] if country == "US" and not state and not city else [])


def place_mentioned(text: Column, words: Sequence[str], cities: Sequence[str] = ()) -> Column:
    """The first of a place's words that a text has, else the first of its cities; codes of up to three letters as they are written."""
    flat = F.regexp_replace(text, r"\s+", " ")
    out = F.when(F.lit(False), "")
    for w in [*words, *cities]:
        quoted = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in w)
        out = out.when(flat.rlike(rf"{'' if len(w) <= 3 else '(?i)'}\b{quoted}\b"), w)
    return out


def foreign_state(text: Column, requested: str) -> Column:
    """Whether a text names a state other than the requested one."""
    others = [name for name in STATES.values() if name != requested.strip().lower()]
    return text.rlike(rf"(?i)\b({'|'.join(others)})\b")


def investor_allowed(name: Column, category: Column) -> Column:
    """Whether a mapped place may be an investor's, by its name and category."""
    return ~name.rlike(NO_INVESTOR_NAMES) & ~F.coalesce(category, F.lit("")).rlike(NO_INVESTOR_CATEGORIES) & name.rlike(INVESTOR_NAMES)


def category_reason(text: Column, name: Column, kinds: Sequence[str]) -> Column:
    """Why a hit is not of the requested kinds; null if it may be."""
    joined = " ".join(kinds).lower()
    if any(k in joined for k in INVESTOR_KINDS.split("|")):
        signs = [sign for words, sign in KIND_SIGNS if any(w in joined for w in words.split("|"))]
        fits = F.lit(False)
        for sign in signs or [INVESTORS]:
            fits |= text.rlike(sign)
        return F.when((text.rlike(OTHER_TRADES) & ~text.rlike(REAL_ESTATE)) | ~fits, "NOT_REAL_ESTATE_INVESTOR")
    out = F.lit("CATEGORY_MISMATCH")
    for k in kinds:
        verdict, reason = verdicts.category(k, text, name)
        out = F.when(verdict != "NO_MATCH", F.lit(None).cast("string")).otherwise(out if k != kinds[0] else reason)
    return out if kinds else F.lit(None).cast("string")


def assess(hits: DataFrame, kinds: Sequence[str], city: str | None = None, state: str | None = None, country: str | None = None, cities: Sequence[str] = (), exclusions: Sequence[str] = ()) -> DataFrame:
    """`hits` (title, url, snippet and more) with name, website, external_id, place and reason; those without a reason are accepted.

    The tests come in this order: URL, job board, URL gate, list, name, place, category, exclusions.
    """
    c = F.col
    tidy = F.trim(F.regexp_replace(F.concat_ws(" ", "title", "snippet"), r"\s+", " "))
    rows = hits.withColumns({"_text": tidy, "name": name_from_title(c("title")), "_host": F.when(c("url").rlike("(?i)^https?://"), host(c("url")))})
    rows = rows.withColumn("_rest", F.when(c("name").isNotNull(), F.replace(F.lower("_text"), F.lower("name"), F.lit(" "))).otherwise(F.lower("_text")))
    words = place_words(city, state, country)
    # The company's name apart, a place may stand anywhere; codes need their case.
    found = place_mentioned(F.when(c("name").isNotNull(), F.replace(c("_text"), c("name"), F.lit(" "))).otherwise(c("_text")), words, cities)
    if state and not city and any(k in " ".join(kinds).lower() for k in INVESTOR_KINDS.split("|")):
        found = F.coalesce(found, F.when(~foreign_state(c("_text"), state), "plan_state_query_context"))
    rows = rows.withColumn("place", found if words else F.lit(None).cast("string"))
    board = c("_host").rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in JOB_BOARDS) + ")$")
    excluded = F.lit(False)
    for phrase in exclusions:
        excluded |= verdicts.exclusion(phrase, c("_text"), c("name")) == "EXCLUDED"
    reason = (
        F.when(c("_host").isNull(), "INVALID_URL").when(board, "JOB_BOARD").when(reject_url(c("url")).isNotNull(), reject_url(c("url"))).when(c("_text").rlike(LISTS), "GENERIC_LIST").when(c("name").isNull(), "UNUSABLE_NAME")
        .when(F.lit(bool(words)) & c("place").isNull(), "OUTSIDE_REQUESTED_LOCATION").when(category_reason(c("_text"), c("name"), kinds).isNotNull(), category_reason(c("_text"), c("name"), kinds)).when(excluded, "EXCLUSION_MATCH")
    )
    website = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    external = F.substring(F.sha2(F.concat_ws("|", F.lower("name"), "_host"), 256), 1, 40)
    judged = rows.withColumns({"website": website, "external_id": external, "country": country_code(F.lit(country)) if country in COUNTRIES or country else F.lit(None).cast("string"), "reason": reason})
    return judged.drop("_text", "_host", "_rest")


def collect(judged: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """Of assessed hits (id in the order of batches and hits) the first `target` accepted ones without a duplicate, and how many were dropped for what reason."""
    # The rules cost much for each text and what they find is read several times: it is written once, so callers leave out texts they do not need.
    judged = settled(judged)
    accepted = judged.filter("reason IS NULL").withColumn("keys", identity_keys(F.col("external_id"), F.col("website"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    single = first_wins(accepted)
    total, kept = accepted.agg(F.count("*").alias("n")), single.agg(F.count("*").alias("k"))
    duplicates = total.crossJoin(F.broadcast(kept)).select(F.lit("DUPLICATE").alias("reason"), (F.col("n") - F.col("k")).alias("n"))
    dropped = judged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).unionByName(duplicates)
    return single.orderBy("id").limit(target).drop("keys"), dropped


def company_profiles(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, url, n): public profiles of a company among hits (company, title, url, snippet, n), each once, with the first hit that gives it.

    A hit counts if it names the company and its title is not about another one that shares a telling word.
    """
    c = F.col
    words = lambda x: F.filter(F.split(plain(x), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*LEGAL_WORDS, *FILLERS))
    subject = F.trim(F.get(F.split(c("title"), r"\s+[|–—]\s+|\s+-\s+"), 0))
    target, candidate = plain(c("company")), plain(subject)
    other = (
        (candidate != "") & ~candidate.contains(target) & ~target.contains(candidate) & F.coalesce(F.arrays_overlap(words(c("company")), words(subject)), F.lit(False))
        & ((F.size(F.array_except(words(subject), words(c("company")))) > 0) | ~plain(F.concat_ws(" ", "title", "snippet")).contains(target))
    )
    url = social_url(c("url"))
    path = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    word, site = F.lower(F.get(path, 0)), host(url)
    page = site.rlike(r"^(facebook|instagram|twitter|x)\.com$") & ~word.isin(*NO_ACCOUNTS, "profile.php")
    public = ((site == "linkedin.com") & (word == "company") & (F.size(path) >= 2)) | ((F.size(path) == 1) & (page | (site.isin("youtube.com", "youtu.be") & word.startswith("@"))))
    named = F.lower(F.concat_ws(" ", "title", "snippet")).contains(F.lower(F.trim("company"))) & (F.length(F.trim("company")) >= 3)
    return hits.filter(named & ~F.coalesce(other, F.lit(False)) & F.coalesce(public, F.lit(False))).groupBy(*keys, url.alias("url")).agg(F.min("n").alias("n"))


def specialization(text: Column, investor_type: Column, lead_types: Sequence[str], broad: Column) -> Column:
    """The code of the criterion on a special lead type; `broad` says whether evidence of investors at large is there, which only needs review."""
    joined = [t.lower() for t in lead_types]
    groups = [(types, sign) for types, sign in SPECIALIZATIONS if any(w in t for t in joined for w in types.split("|"))]
    if not groups:
        return F.lit("MATCH")
    fits, typed = F.lit(False), F.lit(False)
    for types, sign in groups:
        fits |= F.coalesce(text.rlike(sign), F.lit(False))
        typed |= F.coalesce(F.regexp_replace(F.lower(investor_type), r"\s+", "_").rlike(types), F.lit(False))
    return F.when(fits | typed, "MATCH").when(broad, "NEEDS_REVIEW").otherwise("NEEDS_REVIEW")
