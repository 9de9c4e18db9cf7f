"""URL parts and canonical forms. Each normaliser keeps its own rules; they differ on purpose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "net.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "org.nz", "net.nz", "co.jp", "or.jp", "ne.jp", "co.kr",
    "com.br", "com.mx", "com.ar", "co.in", "com.sg", "com.hk", "com.tw", "co.za", "org.za", "com.tr", "com.ua",
)
#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")


def host(url: Column) -> Column:
    """The host in lower case without one leading www., of a URL or a bare host; null if there is none."""
    whole = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    found = F.try_parse_url(F.trim(whole), F.lit("HOST"))
    return F.nullif(F.regexp_replace(F.lower(found), r"^www\.", ""), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once for each row however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, three under a two-label public suffix."""

    def of(labels: Column) -> Column:
        last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
        return F.when(F.size(labels) < 2, F.array_join(labels, ".")).when((F.size(labels) >= 3) & last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))

    return once(F.filter(F.split(host(url), r"\."), lambda x: x != ""), of)


def social_url(url: Column) -> Column:
    """https, host without www., no query or fragment, no trailing slash."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/$", "")
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.concat(F.lit("https://"), host(url), path))


def source_url(url: Column) -> Column:
    """Protocol, host and path as they stand, the fragment and query gone."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), host(url), path)


def research_url(url: Column) -> Column:
    """Canonical page URL: no www., fragment, tracking parameters or trailing slashes."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)), "&")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), host(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def same_site(left: Column, right: Column) -> Column:
    """Equal hosts, or one under the other."""
    a, b = host(left), host(right)
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


#: Query parameters that a crawl leaves out beside the tracking ones.
CRAWL_EXTRA = ("msclkid", "mc_cid", "mc_eid", "ref", "source")


def crawl_url(url: Column) -> Column:
    """Crawl form: no user, default port, www., fragment or tracking; a page named index is its folder."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING, *CRAWL_EXTRA)), "&")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/index\.(html?|php)$", "/")
    path = F.when(path == "", "/").otherwise(path)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*:([0-9]+)", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    return F.concat(scheme, F.lit("://"), host(url), shown, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def source_website(url: Column) -> Column:
    """A source row's website: lower case, no fragment, no trailing slash; null unless http or https."""
    tidy = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "/$", "")
    return F.when(tidy.rlike("^https?://[^/]+"), tidy)
