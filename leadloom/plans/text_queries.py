"""Queries over texts, addresses of pages, and page HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.functions import size as S
from leadloom.functions import text as T
from leadloom.functions import urls as U
from leadloom.operators import research
from leadloom.sources import adapters as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '')"


@query(f"SELECT page_id, {_HOST} AS host, regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS registrable FROM pages")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and registrable domain of each page."""
    url = F.col("url")
    return A.table(spark, sf_dir, "pages").select("page_id", U.host(url).alias("host"), U.registrable_domain(url).alias("registrable"))


_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_QUERY = "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid)(=|$)'))"


@query(
    f"""SELECT page_id, 'https://' || {_HOST} || regexp_replace({_PATH}, '/$', '') AS social, lower(regexp_extract(url, '^[A-Za-z]+')) || '://' || {_HOST} || CASE {_PATH} WHEN '' THEN '/' ELSE {_PATH} END AS source,
      lower(regexp_extract(url, '^[A-Za-z]+')) || '://' || {_HOST} || CASE regexp_replace({_PATH}, '/+$', '') WHEN '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END
      || CASE WHEN len({_QUERY}) > 0 THEN '?' || array_to_string({_QUERY}, '&') ELSE '' END AS research FROM pages"""
)
def url_canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three canonical forms of each page's URL."""
    url = F.col("url")
    return A.table(spark, sf_dir, "pages").select("page_id", U.social_url(url).alias("social"), U.source_url(url).alias("source"), U.research_url(url).alias("research"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents WHERE lang = 'en' AND NOT regexp_matches(text, '[^\\x00-\\x7F]')")
def text_normalize_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over English texts that are ASCII only: normal form. text_normalize takes all documents."""
    docs = A.table(spark, sf_dir, "documents").filter((F.col("lang") == "en") & ~F.col("text").rlike(r"[^\x00-\x7F]"))
    return docs.select("doc_id", T.normal_ascii(F.col("text")).alias("plain"))


@query()
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, and T7 of a single part: normal form of the text of every document, decomposed (NFKD), which SQL cannot do."""
    return A.table(spark, sf_dir, "documents").select("doc_id", T.normal_text(F.col("text")).alias("plain"))


@query("SELECT * FROM (VALUES ('ABC Home Buyers, LLC', 'abc home buyers'), ('résumé Inc', 're sume'), ('L.L.C. Oak', 'oak'), (NULL, '')) v(raw, plain)")
def text_normalize_nfkd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks become blanks; legal forms go wherever they stand."""
    rows = spark.createDataFrame([("ABC Home Buyers, LLC",), ("résumé Inc",), ("L.L.C. Oak",), (None,)], "raw string")
    return rows.select("raw", T.company_name(T.normal_text(F.col("raw"))).alias("plain"))


@query(
    """SELECT raw, nullif(CASE WHEN length(d) = 11 AND d LIKE '1%' THEN d[2:] ELSE d END, '') AS national, CASE WHEN d <> '' THEN (CASE WHEN trim(raw) LIKE '+%' THEN '+' ELSE '' END) || d END AS contact,
      CASE WHEN length(d) >= 10 THEN d END AS matching, CASE WHEN length(d) >= 7 THEN (CASE WHEN trim(raw) LIKE '+%' THEN '+' ELSE '' END) || d END AS research, nullif(regexp_replace(raw, '[^0-9+]', '', 'g'), '') AS source
    FROM (SELECT raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM (VALUES ('+1 (555) 010-0000'), ('(415) 555-0100'), ('555-0100'), ('12'), (''), ('+49 30+1')) v(raw))"""
)
def phone_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five normal forms of a phone number."""
    raw = F.col("raw")
    rows = spark.createDataFrame([(x,) for x in ("+1 (555) 010-0000", "(415) 555-0100", "555-0100", "12", "", "+49 30+1")], "raw string")
    return rows.select("raw", T.national_phone(raw).alias("national"), T.contact_phone(raw).alias("contact"), T.match_phone(raw).alias("matching"), T.research_phone(raw).alias("research"), T.source_phone(raw).alias("source"))


@query(
    f"""SELECT doc_id, len(e) AS n_emails, e[1] AS first_email, len(p) AS n_phones FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '{T.EMAIL}'), lambda x: lower(x))) AS es, regexp_extract_all(text, '{T.EMAIL}') AS e0,
      list_distinct(list_transform(regexp_extract_all(text, '{T.PHONE}'), lambda x: regexp_replace(x, '[^0-9+]', '', 'g'))) AS p, [lower(regexp_extract_all(text, '{T.EMAIL}')[1])] AS f, es AS unused FROM documents) t,
      LATERAL (SELECT CASE WHEN len(es) = 0 THEN [] ELSE list_concat(f, list_filter(es, lambda x: x <> f[1])) END AS e) WHERE len(es) > 0 OR len(p) > 0"""
)
def contacts_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers found in texts."""
    found = A.table(spark, sf_dir, "documents").select("doc_id", T.emails(F.col("text")).alias("e"), T.phones(F.col("text")).alias("p")).filter((F.size("e") > 0) | (F.size("p") > 0))
    return found.select("doc_id", F.size("e").cast("long").alias("n_emails"), F.get("e", 0).alias("first_email"), F.size("p").cast("long").alias("n_phones"))


_GENERIC = ", ".join(f"'{x}'" for x in T.GENERIC_MAILBOXES)


@query(
    f"""SELECT email, local IN ({_GENERIC}) OR local LIKE '%noreply%' OR local LIKE '%no-reply%' AS generic, CASE WHEN NOT (local IN ({_GENERIC}) OR local LIKE '%noreply%' OR local LIKE '%no-reply%') AND local NOT IN ('john', 'jane') AND email NOT LIKE '%@example.com' THEN email END AS person
    FROM (SELECT email, split_part(email, '@', 1) AS local FROM (VALUES ('info@a.example'), ('ada@a.example'), ('my-noreply@b.example'), ('jane@b.example'), ('ada@example.com')) v(email))"""
)
def email_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes of companies and of persons."""
    rows = spark.createDataFrame([(x,) for x in ("info@a.example", "ada@a.example", "my-noreply@b.example", "jane@b.example", "ada@example.com")], "email string")
    return rows.select("email", T.is_generic_mailbox(F.col("email")).alias("generic"), T.person_email(F.concat(F.lit("write to "), F.col("email"), F.lit(" or bob@c.example"))).alias("person"))


_VISIBLE = "html"
for _tag in ("script", "style", "noscript", "nav"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
_VISIBLE = f"trim(regexp_replace(regexp_replace(regexp_replace({_VISIBLE}, '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '\\s+', ' ', 'g'))"
_HREFS = "regexp_extract_all(html, '(?i)<a[^>]+href=[\"'']([^\"''#]+)', 1)"


@query(f"SELECT page_id, {_VISIBLE} AS visible, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages")
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 H2 H3: visible text and title of pages."""
    html = F.col("html")
    return A.table(spark, sf_dir, "pages").select("page_id", H.visible_text(html).alias("visible"), H.title(html).alias("title"))


@query(f"SELECT DISTINCT page_id, t AS target, CASE WHEN regexp_matches(t, '^[A-Za-z]+://') THEN t WHEN t LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/]+)', 1) || t END AS link FROM (SELECT page_id, url, unnest({_HREFS}) AS t FROM pages) WHERE t LIKE '/%' OR regexp_matches(t, '^[A-Za-z]+://')")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, resolved against the page."""
    one = A.table(spark, sf_dir, "pages").select("page_id", "url", F.explode(H.hrefs(F.col("html"))).alias("target"))
    return one.filter(F.col("target").startswith("/") | F.col("target").rlike("^[A-Za-z]+://")).select("page_id", "target", H.resolve(F.col("target"), F.col("url")).alias("link"))


_SCORED = """CASE WHEN path = '/' THEN 5 ELSE 0 END + CASE WHEN regexp_matches(path, '(/about|/about-us|/team|/leadership|/management|/company|/contact|/our-team|/who-we-are|/services|/properties|/portfolio|/investments)$') THEN 8 ELSE 0 END
      + 2 * len(list_filter(['leadership', 'founder', 'ceo', 'president', 'owner', 'management', 'team', 'company', 'acquisition', 'investment', 'properties', 'portfolio', 'contact', 'email', 'phone', 'linkedin', 'facebook', 'instagram', 'youtube'], lambda t: contains(path || ' ' || lower(anchor), t)))"""
_LOW_PATH = "lower(coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)?', 1), ''), '/'))"
#: Paths that pages of a site are given in turn, since those of the table say nothing of what they are.
_GIVEN = ("", "/about-us", "/de/team/", "/people", "/Contact", "/our-services/list", "/who-we-are", "/products/x", "/ceo-letter")


@query(
    """SELECT host, url, score, rank FROM (SELECT host, url, score, row_number() OVER (PARTITION BY host ORDER BY score DESC, url) AS rank FROM (SELECT DISTINCT host, url, %s AS score FROM (SELECT url, '' AS anchor, %s AS host, %s AS path FROM pages))) WHERE rank <= 3"""
    % (_SCORED, _HOST, _LOW_PATH)
)
def page_relevance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: the three pages of each site that promise most."""
    pages = A.table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), "url", H.relevance(F.col("url")).alias("score")).distinct()
    w = Window.partitionBy("host").orderBy(F.desc("score"), "url")
    return pages.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("host", "url", "score", "rank")


@query(
    """WITH given(i, path, rank) AS (VALUES (0, '', 0), (1, '/about-us', 4), (2, '/de/team/', 3), (3, '/people', 0), (4, '/Contact', 3), (5, '/our-services/list', 0), (6, '/who-we-are', 4), (7, '/products/x', 2), (8, '/ceo-letter', 0))
    SELECT page_id, %s AS host, rank, (row_number() OVER (PARTITION BY %s ORDER BY rank DESC, page_id))::INT AS position FROM pages JOIN given ON i = page_id %% 9"""
    % (_HOST, _HOST)
)
def page_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's pages in the order in which they are fetched: by rank, equal ones as they come."""
    pages = A.table(spark, sf_dir, "pages")
    path = F.get(F.array(*map(F.lit, _GIVEN)), (F.col("page_id") % len(_GIVEN)).cast("int"))
    ranked = pages.select("page_id", U.host(F.col("url")).alias("host"), H.page_rank(F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1), path)).alias("rank"))
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("rank"), "page_id")))


_LINKS = r"""SELECT page_id, url, %s AS host, unnest(regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS target, unnest(regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS inside FROM pages""" % _HOST


@query(
    rf"""SELECT page_id, CASE WHEN target LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/]+)', 1) || target ELSE target END AS link, trim(regexp_replace(regexp_replace(inside, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS anchor FROM ({_LINKS})
    WHERE target LIKE '/%' OR (regexp_matches(target, '(?i)^https?://') AND regexp_replace(lower(regexp_extract(target, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\.', '') = host)"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: links of pages to pages of their own site, with their text."""
    one = A.table(spark, sf_dir, "pages").select("page_id", F.explode(H.links(F.col("html"), F.col("url"))).alias("l"))
    return one.select("page_id", "l.link", "l.anchor")


@query(
    rf"""WITH RECURSIVE p AS (SELECT DISTINCT {_HOST} AS site, url FROM pages), home AS (SELECT site, min(url) AS url FROM p GROUP BY site),
    nav AS (SELECT site, url, lead(url) OVER (PARTITION BY site ORDER BY url) AS link, 'next of the team' AS anchor FROM p),
    own AS (SELECT host AS site, url, regexp_extract(url, '^([A-Za-z]+://[^/]+)', 1) || target AS link, trim(regexp_replace(regexp_replace(inside, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS anchor FROM ({_LINKS}) WHERE target LIKE '/%'),
    edges AS (SELECT * FROM nav WHERE link IS NOT NULL UNION ALL SELECT * FROM own),
    walk AS (SELECT site, url, 0 AS depth FROM home UNION SELECT e.site, e.link, w.depth + 1 FROM walk w JOIN edges e ON e.site = w.site AND e.url = w.url WHERE w.depth < 3),
    lev AS (SELECT site, url, min(depth) AS depth FROM walk GROUP BY site, url),
    said AS (SELECT a.site, a.url, a.depth, coalesce(e.anchor, 'home') AS anchor, {_LOW_PATH.replace("url", "a.url")} AS path FROM lev a LEFT JOIN (SELECT e.site, e.link, e.anchor, b.depth FROM edges e JOIN lev b ON b.site = e.site AND b.url = e.url) e ON e.site = a.site AND e.link = a.url AND e.depth = a.depth - 1),
    scored AS (SELECT site, url, depth, max({_SCORED}) AS score FROM said GROUP BY site, url, depth),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth > 0, score DESC, url)::INT AS rank FROM scored WHERE depth = 0 OR score > 0)
    SELECT site, url, depth, score, rank FROM ranked WHERE rank <= 4"""
)
def research_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages of each site, from its home page over at most three links; pages link to what they say and to the next of their site."""
    pages = A.table(spark, sf_dir, "pages").withColumn("site", U.host(F.col("url")))
    known = pages.select("site", "url").distinct()
    own = pages.select("site", "url", F.explode(H.links(F.col("html"), F.col("url"))).alias("l")).select("site", "url", "l.link", "l.anchor")
    following = known.withColumn("link", F.lead("url").over(Window.partitionBy("site").orderBy("url"))).filter("link IS NOT NULL").withColumn("anchor", F.lit("next of the team"))
    homes = known.groupBy("site").agg(F.min("url").alias("url"))
    return research.plan(research.levels(homes, own.unionByName(following), 3), 4)


_TEXTS = [
    "Oak Stream Investors has 23 employees", "employees = 1", "Company size: 11-50 employees", "has 10+ employees", "approximately 25 employees", "We are a small company", "3.3 Employee stealing from clients",
    "Accounts 266 Employees 5 Advisory reps 3", "51 to 200 employees worldwide", "company size 90-20", "nothing",
]
_SIZES = [("exact", 23, 23), ("exact", 1, 1), ("range", 11, 50), ("unusable", None, None), ("unusable", None, None), ("unusable", None, None), (None, None, None), ("exact", 5, 5), ("range", 51, 200), (None, None, None), (None, None, None)]
_null = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


@query(f"SELECT raw, kind, low, high FROM (VALUES {', '.join(f'({_null(t)}, {_null(k)}, {_null(a)}, {_null(b)})' for t, (k, a, b) in zip(_TEXTS, _SIZES))}) v(raw, kind, low, high)")
def employee_size_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee sizes in sentences; hedged numbers are unusable."""
    return spark.createDataFrame([(t,) for t in _TEXTS], "raw string").withColumn("s", S.extract(F.col("raw"))).select("raw", "s.kind", "s.low", "s.high")


@query("SELECT * FROM (VALUES (1, 'conflict', 11, 50, 51, 200), (2, 'value', 23, 23, NULL, NULL), (3, 'none', NULL, NULL, NULL, NULL), (4, 'value', 20, 30, NULL, NULL)) v(id, outcome, low, high, other_low, other_high)")
def employee_size_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest of nested spans, or the first two that conflict, in the order found."""
    rows = [(1, [(11, 50), (51, 200), (12, 13)]), (2, [(11, 50), (23, 23)]), (3, []), (4, [(20, 30), (1, 90), (20, 30)])]
    found = spark.createDataFrame(rows, "id int, spans array<struct<low:int,high:int>>")
    return found.withColumn("r", S.reconcile(F.col("spans"))).select("id", "r.outcome", "r.low", "r.high", "r.other_low", "r.other_high")


@query(
    """SELECT low, high, CASE WHEN hi <= high AND lo >= low THEN 'MATCHED' WHEN hi < low OR lo > high THEN 'OUTSIDE_RANGE' ELSE 'UNKNOWN' END AS fit, raw FROM (SELECT *, TRY_CAST(regexp_extract(raw, '([0-9]+)\\s*(-|–|to)\\s*([0-9]+)', 1) AS INTEGER) AS lo,
      TRY_CAST(regexp_extract(raw, '([0-9]+)\\s*(-|–|to)\\s*([0-9]+)', 3) AS INTEGER) AS hi FROM (VALUES (10, 60, '11-50'), (10, 60, '11 to 70'), (10, 60, '70–90'), (10, 60, 'many')) v(low, high, raw))"""
)
def size_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a written range fits bounds."""
    rows = spark.createDataFrame([("11-50",), ("11 to 70",), ("70–90",), ("many",)], "raw string")
    return rows.select(F.lit(10).alias("low"), F.lit(60).alias("high"), S.fit(F.lit(None).cast("int"), F.col("raw"), 10, 60).alias("fit"), "raw")


@query("SELECT * FROM (VALUES ('Co-Founder & CEO', 'FOUNDER'), ('Vice President', 'PRESIDENT'), ('chief executive officer', 'CEO'), ('Office Manager', 'MANAGER'), ('Analyst', 'ANALYST')) v(title, role)")
def title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of titles, rung by rung."""
    rows = spark.createDataFrame([(x,) for x in ("Co-Founder & CEO", "Vice President", "chief executive officer", "Office Manager", "Analyst")], "title string")
    return rows.withColumn("role", T.title_role(F.col("title")))


@query(
    """SELECT item_id, doc_id FROM (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS excerpt FROM benchmark) b JOIN (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS body FROM documents) d
      ON contains(body, excerpt) WHERE excerpt <> ''"""
)
def claim_excerpt_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose excerpt stands in a page: equi-joins on inner words, or on first characters, before the containment test.

    Inner words of an excerpt are whole words of the page. Six words have four inner ones, three have one;
    shorter excerpts may begin and end within words and are looked up by their first three characters.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    claims = A.table(spark, sf_dir, "benchmark").select("item_id", flat("text").alias("excerpt")).filter("excerpt <> ''").withColumn("w", F.split("excerpt", " "))
    pages = A.table(spark, sf_dir, "documents").select("doc_id", flat("text").alias("body"))
    words = pages.withColumn("w", F.split("body", " "))
    runs = F.expr("if(size(w) < 4, cast(array() as array<bigint>), transform(sequence(0, size(w) - 4), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3])))")
    grams = lambda n: F.expr(f"if(length(body) < {n}, cast(array() as array<string>), transform(sequence(1, length(body) - {n - 1}), i -> substring(body, i, {n})))")
    asked = [
        (claims.filter(F.size("w") >= 6).select("item_id", "excerpt", F.expr("xxhash64(w[1], w[2], w[3], w[4])").alias("key")), words.select("doc_id", F.explode(F.array_distinct(runs)).alias("key"))),
        (claims.filter(F.size("w").between(3, 5)).select("item_id", "excerpt", F.get("w", 1).alias("key")), words.select("doc_id", F.explode(F.array_distinct("w")).alias("key"))),
    ]
    for n in (1, 2, 3):
        size = F.length("excerpt") == n if n < 3 else F.length("excerpt") >= 3
        asked.append((claims.filter((F.size("w") < 3) & size).select("item_id", "excerpt", F.substring("excerpt", 1, n).alias("key")), pages.select("doc_id", F.explode(F.array_distinct(grams(n))).alias("key"))))
    parts = [at.join(keyed, "key").select("doc_id", "item_id", "excerpt").distinct() for keyed, at in asked if not keyed.isEmpty()]
    hits = reduce(DataFrame.unionByName, parts) if parts else claims.select(F.lit(None).cast("long").alias("doc_id"), "item_id", "excerpt").limit(0)
    return hits.join(pages, "doc_id").filter(F.contains("body", "excerpt")).select("item_id", "doc_id").distinct()
