"""Normal forms and matches over whole tables, beside the cases of the other modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import size
from leadloom.functions import text as T
from leadloom.functions import urls as U
from leadloom.operators import resolve as R
from leadloom.operators import verdicts as V
from leadloom.operators.relational import block_classes, signature_classes
from leadloom.plans.entities_sql import COMPANIES, with_
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


@query(
    """WITH t AS (SELECT c_custkey AS id, (['+1 (555) 01', '1-555-01', ' 555.01', '01+'])[c_custkey % 4 + 1] || (c_custkey % 90000) AS phone, (['Info', ' ann.b', 'no-reply', 'Jane'])[c_custkey // 4 % 4 + 1] || '@Co' || (c_custkey % 400) || '.example ' AS email FROM customer),
    d AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d, CASE WHEN trim(phone) LIKE '+%' THEN '+' ELSE '' END AS plus, lower(trim(email)) AS mail FROM t)
    SELECT id, nullif(CASE WHEN length(d) = 11 AND d LIKE '1%' THEN d[2:] ELSE d END, '') AS national, plus || d AS contact, CASE WHEN length(d) >= 10 THEN d END AS matching, CASE WHEN length(d) >= 7 THEN plus || d END AS research,
      regexp_replace(phone, '[^0-9+]', '', 'g') AS source, mail AS email, mail LIKE 'info@%' OR mail LIKE 'no-reply@%' AS generic FROM d"""
)
def company_contact_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of companies' numbers and addresses."""
    k = F.col("c_custkey")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    phone = F.concat(pick(["+1 (555) 01", "1-555-01", " 555.01", "01+"], k), (k % 90000).cast("string"))
    mail = F.concat(pick(["Info", " ann.b", "no-reply", "Jane"], F.floor(k / 4)), F.lit("@Co"), (k % 400).cast("string"), F.lit(".example "))
    rows = A.table(spark, sf_dir, "customer").select(k.alias("id"), phone.alias("p"), mail.alias("m"))
    p, m = F.col("p"), F.col("m")
    return rows.select("id", T.national_phone(p).alias("national"), T.contact_phone(p).alias("contact"), T.match_phone(p).alias("matching"), T.research_phone(p).alias("research"), T.source_phone(p).alias("source"), T.email(m).alias("email"), T.is_generic_mailbox(m).alias("generic"))


_DROPPED = ", ".join(f"'{p}'" for p in (*U.TRACKING, *U.CRAWL_EXTRA))


@query(
    f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
    k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_DROPPED})), '&') AS kept FROM p)
    SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS crawl, regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '/$', '') AS website FROM k"""
)
def page_url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages' addresses as they are crawled, and as a source row's website."""
    return A.table(spark, sf_dir, "pages").select("page_id", U.crawl_url(F.col("url")).alias("crawl"), U.source_website(F.col("url")).alias("website"))


@query(
    """WITH r AS (SELECT c_custkey AS id, 'name ' || (c_custkey // 5) AS name, CASE WHEN c_custkey % 3 > 0 THEN 'd' || (c_custkey // 4) ELSE '' END AS domain, CASE WHEN c_custkey % 4 > 0 THEN '555' || (c_custkey // 6) ELSE '' END AS phone,
      CASE WHEN c_custkey % 11 < 2 THEN 'p' || (c_custkey // 11) ELSE '' END AS place, CASE WHEN c_custkey % 7 < 3 THEN 'x' || (c_custkey // 7) END AS ext, CASE WHEN c_custkey % 5 < 3 THEN 'm' || (c_custkey // 5) ELSE '' END AS mail, (c_custkey // 2) % 2 = 0 AS verified, (c_custkey // 3) % 2 AS city FROM customer),
    keyed AS (SELECT *, min(id) OVER w AS class FROM r WINDOW w AS (PARTITION BY name, domain, phone, place, ext, mail, verified, city)),
    m AS (SELECT a.class AS a, b.class AS b, a.domain = b.domain AND a.domain <> '' AS dom, a.phone = b.phone AND a.phone <> '' AS ph, a.verified AND b.verified AS v, a.place = b.place AND a.place <> '' AS pl, coalesce(a.ext = b.ext, false) AS ex, a.mail = b.mail AND a.mail <> '' AS ml, a.name = b.name AS nm, a.city = b.city AS loc,
        a.domain <> '' AND b.domain <> '' AND a.domain <> b.domain AS diff FROM keyed a JOIN keyed b ON a.id < b.id AND b.id < a.id + 12),
    s AS (SELECT *, dom OR pl OR ex OR ((ph OR ml) AND v) AS hard, least(100, CASE WHEN ex THEN 55 ELSE 0 END + CASE WHEN pl THEN 55 ELSE 0 END + CASE WHEN dom THEN 55 ELSE 0 END + CASE WHEN ph AND v THEN 55 WHEN ph THEN 20 ELSE 0 END + CASE WHEN ml AND v THEN 55 ELSE 0 END
        + CASE WHEN nm THEN 10 ELSE 0 END + CASE WHEN loc THEN 8 ELSE 0 END) AS score FROM m WHERE dom OR ph OR pl OR ex OR ml OR nm),
    d AS (SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN diff AND nm AND loc THEN 'CONFLICT' WHEN NOT hard AND nm AND loc THEN 'NEEDS_REVIEW' WHEN score >= 55 AND hard THEN 'AUTO_DUPLICATE' WHEN score >= 30 THEN 'NEEDS_REVIEW' ELSE 'PENDING' END AS status,
      (CASE WHEN diff AND nm AND loc THEN 50 WHEN NOT hard AND nm AND loc THEN least(greatest(score, 30), 40) ELSE score END / 100.0)::DOUBLE AS confidence FROM s)
    SELECT a, b, status, confidence, count(*) AS links FROM d GROUP BY ALL"""
)
def company_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every pair of companies that share any of six keys, a row for each pair of classes of equal records.

    `links` counts the pairs of companies that a row stands for. Neighbouring customers share keys, so their number grows with the table.
    """
    k = F.col("c_custkey")
    text = lambda lead, n: F.concat(F.lit(lead), F.floor(k / n).cast("string"))
    empty = F.lit("")
    verified = F.floor(k / 2) % 2 == 0
    records = A.table(spark, sf_dir, "customer").select(
        k.alias("id"), text("name ", 5).alias("name"), F.when(k % 3 > 0, text("d", 4)).otherwise("").alias("domain"), F.when(k % 4 > 0, text("555", 6)).otherwise("").alias("phone"), F.when(k % 11 < 2, text("p", 11)).otherwise("").alias("place_id"), empty.alias("address"),
        (F.floor(k / 3) % 2).cast("string").alias("city"), F.lit("s").alias("state"), F.when(k % 5 < 3, text("m", 5)).otherwise("").alias("email"), empty.alias("email_domain"), F.array().cast("array<string>").alias("social_urls"),
        F.when(k % 7 < 3, F.array(text("x", 7))).otherwise(F.array().cast("array<string>")).alias("external_ids"), verified.alias("phone_verified"), verified.alias("email_verified"),
    )
    classes = signature_classes(records, "id")
    kinds = ("domain", "phone", "place_id", "email", "name")
    keys = F.concat(F.array(*(F.struct(F.lit(x).alias("kind"), F.col(x).alias("key")) for x in kinds)), F.transform("external_ids", lambda x: F.struct(F.lit("external").alias("kind"), x.alias("key"))))
    decided = R.match_companies(classes, block_classes(classes, "id", keys)).select("a", "b", "status", "confidence")
    sizes = classes.select("id", "members")
    joined = decided.join(sizes.withColumnsRenamed({"id": "a", "members": "n"}), "a").join(sizes.withColumnsRenamed({"id": "b", "members": "m"}), "b")
    return joined.select("a", "b", "status", "confidence", F.when(F.col("a") == F.col("b"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m")).cast("long").alias("links"))


#: Texts about a company called Oak, and the verdict and reason of a request for real-estate investors.
CATEGORY_TEXTS = (
    ("Oak is a real estate agent", "NEEDS_REVIEW", "CATEGORY_AMBIGUOUS"), ("We buy houses in Dallas", "MATCH", "CATEGORY_EVIDENCE"), ("property management for owners", "NO_MATCH", "CATEGORY_CONFLICT"), ("bakery and cakes", "NO_MATCH", "CATEGORY_MISMATCH"),
    ("Fix  and\nflip of homes", "MATCH", "CATEGORY_EVIDENCE"), ("mortgage advice for every acquisition", "NEEDS_REVIEW", "CATEGORY_AMBIGUOUS"), ("", "NO_MATCH", "CATEGORY_MISMATCH"),
)


@query(
    "WITH t(i, verdict, reason) AS (VALUES "
    + ", ".join(f"({i}, '{v}', '{r}')" for i, (_, v, r) in enumerate(CATEGORY_TEXTS))
    + """) SELECT s_suppkey AS id,
      CASE WHEN s_suppkey % 5 = 4 AND i IN (3, 6) THEN 'MATCH' WHEN s_suppkey % 5 = 4 AND i = 2 THEN 'NEEDS_REVIEW' WHEN s_suppkey % 9 = 8 AND i IN (3, 6) THEN 'NEEDS_REVIEW' ELSE verdict END AS verdict,
      CASE WHEN s_suppkey % 5 = 4 AND i IN (3, 6) THEN 'CATEGORY_EVIDENCE' WHEN s_suppkey % 5 = 4 AND i = 2 THEN 'CATEGORY_AMBIGUOUS' WHEN s_suppkey % 9 = 8 AND i IN (3, 6) THEN 'CATEGORY_NAME_ONLY' ELSE reason END AS reason
      FROM supplier JOIN t ON i = s_suppkey % 7"""
)
def category_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-estate investors asked for, over all suppliers: texts, tagged categories and names of several kinds."""
    k = F.col("s_suppkey")
    text = F.get(F.array(*(F.lit(t) for t, *_ in CATEGORY_TEXTS)), (k % len(CATEGORY_TEXTS)).cast("int"))
    name = F.when(k % 9 == 8, "Elm Real Estate Investor").when(k % 9 == 7, "Re").otherwise("Oak")
    verdict, reason = V.category("real_estate_investor", text, name, F.when(k % 5 == 4, "house_buying"))
    return A.table(spark, sf_dir, "supplier").select(k.alias("id"), verdict.alias("verdict"), reason.alias("reason"))


@query(
    """WITH e AS (SELECT o_custkey AS id, CASE WHEN l_suppkey % 4 = 0 THEN 'Ann P' || o_custkey || ' ann' || o_custkey || '@co.example' WHEN l_suppkey % 4 = 1 THEN 'write to ANN' || o_custkey || '@co.example' ELSE 'Ann P' || o_custkey END AS x, l_suppkey % 7 AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT c_custkey AS id, count(DISTINCT s) FILTER (WHERE x LIKE 'Ann P%@%') AS sources, count(DISTINCT s) FILTER (WHERE x LIKE 'Ann P%@%') >= 2 AS verified FROM customer LEFT JOIN e ON e.id = c_custkey GROUP BY 1"""
)
def contact_email_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which contacts own their address, by independent sources that name them with it."""
    k, c, s = F.col("c_custkey").cast("string"), F.col("o_custkey").cast("string"), F.col("l_suppkey")
    people = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Ann P"), k).alias("name"), F.concat(F.lit("ann"), k, F.lit("@co.example")).alias("email"))
    lines = A.table(spark, sf_dir, "lineitem").join(A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    excerpt = (
        F.when(s % 4 == 0, F.concat(F.lit("Ann P"), c, F.lit(" ann"), c, F.lit("@co.example"))).when(s % 4 == 1, F.concat(F.lit("write to ANN"), c, F.lit("@co.example"))).otherwise(F.concat(F.lit("Ann P"), c))
    )
    evidence = lines.select(F.col("o_custkey").alias("contact_id"), excerpt.alias("excerpt"), F.concat(F.lit("https://a.s"), (s % 7).cast("string"), F.lit(".example/x")).alias("source_url"), F.lit("p").alias("provider"))
    return V.ownership(people, evidence)


@query(
    with_(COMPANIES)
    + """, s AS (SELECT id, employee_count AS n, TRY_CAST(split_part(employee_range, '–', 1) AS INTEGER) AS a, TRY_CAST(split_part(employee_range, '–', 2) AS INTEGER) AS b FROM companies)
    SELECT id, CASE WHEN n IS NOT NULL THEN CASE WHEN n BETWEEN 10 AND 60 THEN 'MATCHED' ELSE 'OUTSIDE_RANGE' END WHEN a >= 10 AND b <= 60 THEN 'MATCHED' WHEN b < 10 OR a > 60 THEN 'OUTSIDE_RANGE' ELSE 'UNKNOWN' END AS fit,
      CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a <= 10 AND b >= 60 AND NOT (a = 10 AND b = 60) THEN 'narrower' WHEN a >= 10 AND b <= 60 THEN CASE WHEN a = 10 AND b = 60 THEN 'same' ELSE 'wider' END ELSE 'conflict' END AS relation FROM s"""
)
def company_size_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """companies' size spans against 10 to 60: whether they fit, and how the bounds lie to them."""
    low, high = size.parse_span(F.col("employee_range"))
    relation = F.when(low.isNotNull() & high.isNotNull(), size.relation(low, high, F.lit(10), F.lit(60)))
    return A.companies(spark, sf_dir).select("id", size.fit(F.col("employee_count"), F.col("employee_range"), 10, 60).alias("fit"), relation.alias("relation"))


_PAGE_WORDS = ", ".join(f"'{w}'" for w in V.NOT_NAMES)


@query(
    f"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' '), '\\s+', ' ', 'g')), ' ') AS w FROM documents)
    SELECT doc_id, len(w) BETWEEN 2 AND 4 AND len(list_filter(w, lambda p: NOT regexp_full_match(p, '[A-Z][a-z''’-]+|[A-Z][a-z]+-[A-Z][a-z]+'))) = 0 AND len(list_filter(w, lambda p: lower(p) IN ({_PAGE_WORDS}))) = 0 AS plausible FROM w"""
)
def leading_words_as_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first two words of a text may be a person's name."""
    words = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 2), " ")
    return A.table(spark, sf_dir, "documents").select("doc_id", V.plausible_person(words).alias("plausible"))
