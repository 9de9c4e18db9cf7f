"""Page text, links and facts from HTML as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.urls import host

#: Hosts of social networks, and the platform each stands for.
SOCIAL_HOSTS = {"linkedin.com": "linkedin", "facebook.com": "facebook", "instagram.com": "instagram", "youtube.com": "youtube", "twitter.com": "twitter", "x.com": "x"}
#: Page paths that are read first.
PRIORITY_PATHS = ("/about", "/about-us", "/team", "/leadership", "/management", "/company", "/contact", "/our-team", "/who-we-are", "/services", "/properties", "/portfolio", "/investments")
#: Words in a path or in a link's text that make a page worth reading.
RELEVANCE_TERMS = (
    "leadership", "founder", "ceo", "president", "owner", "management", "team", "company", "acquisition", "investment", "properties", "portfolio", "contact", "email", "phone", "linkedin", "facebook", "instagram", "youtube",
)
#: Paths of a company's own pages by rank.
PAGE_RANKS = {4: "about(?:-us)?|who-we-are|company", 3: "team|our-team|leadership|management|contact", 2: "services|products|industries|markets|investments?|portfolio"}


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, navigation, tags and entities; blanks are collapsed."""
    out = html
    for tag in ("script", "style", "noscript", "nav"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def meta_description(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)), F.lit(""))


def hrefs(html: Column) -> Column:
    """Targets of links, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]+href=[\"']([^\"'#]+)"), F.lit(1)))


def resolve(target: Column, base: Column) -> Column:
    """A link's URL on the page `base`: whole URLs stay, paths get the page's protocol and host."""
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z]+://[^/]+(?:/[^?#]*)?/)", 1)
    return (
        F.when(target.rlike("^[A-Za-z]+://"), target)
        .when(target.rlike("^(mailto|tel|javascript|data):"), None)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), target))
    )


def links(html: Column, base: Column) -> Column:
    """Links of a page as structs of link and anchor, in order: resolved against `base`, the text without tags and double blanks.

    Links to other hosts, for which www. does not count, and those that are no web addresses are left out.
    """
    pattern = r"(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("target"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inside"))
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))
    found = F.transform(pairs, lambda p: F.struct(resolve(F.when(~p["target"].startswith("#"), p["target"]), base).alias("link"), tidy(p["inside"]).alias("anchor")))
    return F.filter(found, lambda x: x["link"].rlike("(?i)^https?://") & (host(x["link"]) == host(base)))


def _path(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+(/[^?#]*)?", 1))
    return F.when(path == "", "/").otherwise(path)


def relevance(url: Column, anchor: Column | None = None) -> Column:
    """How much a page promises: 5 for the root, 8 for a path that is or ends with a priority one, 2 for each word of path or anchor."""
    path = _path(url)
    said = F.lower(F.concat_ws(" ", path, F.coalesce(anchor, F.lit("")) if anchor is not None else F.lit("")))
    words = sum((F.when(said.contains(t), 2).otherwise(0) for t in RELEVANCE_TERMS), F.lit(0))
    ends = F.lit(False)
    for p in PRIORITY_PATHS:
        ends |= path.endswith(p)
    return F.when(path == "/", 5).otherwise(0) + F.when(ends, 8).otherwise(0) + words


def page_rank(url: Column) -> Column:
    """4 for pages about the company, 3 for people and contact, 2 for what it does, else 0."""
    out = None
    for rank, words in PAGE_RANKS.items():
        hit = _path(url).rlike(rf"/(?:{words})(?:/|$)")
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out.otherwise(0)


def social_platform(host: Column) -> Column:
    out = F.when(host.isNull(), None)
    for domain, platform in SOCIAL_HOSTS.items():
        out = out.when((host == domain) | host.endswith("." + domain), platform)
    return out
