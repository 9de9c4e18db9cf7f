"""Queries over verdicts and the smaller normal forms; expected outcomes of fixtures stand in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.functions import text as T
from leadloom.functions import urls as U
from leadloom.operators import verdicts as V
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


def _values(rows: list[tuple], names: str) -> str:
    show = lambda x: "NULL" if x is None else str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


_CATEGORY = [
    (1, "computer repair and it support", "Acme", "NO_MATCH", "CATEGORY_CONFLICT"), (2, "Bright Software", "Bright Software", "NEEDS_REVIEW", "CATEGORY_NAME_ONLY"), (3, "makers of developer tools", "Acme", "MATCH", "CATEGORY_EVIDENCE"),
    (4, "software and computer repair", None, "NEEDS_REVIEW", "CATEGORY_AMBIGUOUS"), (5, "bakery", "Acme", "NO_MATCH", "CATEGORY_MISMATCH"),
]


@query(_values([(a, d, e) for a, _, _, d, e in _CATEGORY], "id, verdict, reason"))
def category_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the text support a requested category, the company's own name apart?"""
    rows = spark.createDataFrame([r[:3] for r in _CATEGORY], "id int, text string, name string")
    verdict, reason = V.category("software", F.col("text"), F.col("name"))
    return rows.select("id", verdict.alias("verdict"), reason.alias("reason"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(license)([^a-z0-9]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9])(versions|version|versio)([^a-z0-9]|$)') THEN 'EXCLUDED' WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(license|versions|version|versio)([^a-z0-9]|$)') THEN 'AMBIGUOUS' ELSE 'CLEAR' END AS verdict FROM documents".replace("|versio)", ")"))
def exclusion_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that an exclusion phrase rules out."""
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("doc_id", V.exclusion("license versions", F.col("text"), F.lit(None).cast("string")).alias("verdict"))


_EVIDENCE = [
    (1, "Ada Example, ada@x.example", "https://x.example/team", "p"), (1, "Write to ada@x.example (Ada M. Example)", "https://y.example", "p"), (2, "Bo Example bo@x.example", "https://x.example/a", "p"), (2, "Bo Example bo@x.example", "https://www.x.example/b", "q"),
    (3, "Cy Example info@x.example", "https://x.example", "p"), (4, "Di Example", "https://x.example", "p"),
]


@query(_values([(1, 2, True), (2, 1, False), (3, 0, False), (4, 0, False)], "id, sources, verified"))
def email_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two independent sources that name the person with the address verify it."""
    people = spark.createDataFrame([(1, "Ada Example", "ada@x.example"), (2, "Bo Example", "bo@x.example"), (3, "Cy Example", "info@x.example"), (4, "Di Example", "di@x.example")], "id int, name string, email string")
    return V.ownership(people, spark.createDataFrame(_EVIDENCE, "contact_id int, excerpt string, source_url string, provider string"))


@query(_values([(1, 2, 0.8, True), (1, 3, 0.62, False), (2, 3, 0.42, False)], "a, b, confidence, same"))
def person_identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted agreement of two candidates on company, title, site and name."""
    rows = [(1, "Ada Example", "Acme", "CEO", "https://acme.example/a", ""), (2, "ada example", "ACME", "CEO", "https://other.example", ""), (3, "Ada Ex", "Acme", "Founder", "https://acme.example/b", "")]
    found = spark.createDataFrame(rows, "id int, full_name string, company string, title string, source_url string, email string")
    joined = found.alias("l").join(found.alias("r"), F.col("l.id") < F.col("r.id"))
    confidence, same = V.same_person("l", "r")
    # Names of (1, 3) share one of three words; 0.35 + 0.2 + 0.2 / 3.
    return joined.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), confidence.alias("confidence"), same.alias("same"))


@query(
    """WITH c AS (SELECT o_custkey AS company_id, 'Co' || (o_custkey % 7) AS name, 'https://s' || (o_orderkey % 2) || '.example' AS website, CASE WHEN o_orderkey % 3 = 0 THEN '555-01' ELSE '' END AS phone FROM orders WHERE o_orderkey % 4 = 0),
    t AS (SELECT company_id, count(*) AS claims, count(DISTINCT lower(name)) AS names, count(DISTINCT website) AS websites, count(DISTINCT nullif(regexp_replace(phone, '[^0-9]', '', 'g'), '')) AS phones FROM c GROUP BY 1)
    SELECT company_id, claims, names, websites, phones, CASE WHEN claims < 2 THEN 0.6 ELSE round(CASE WHEN names <= 1 THEN 0.4 ELSE 0 END + CASE WHEN websites <= 1 THEN 0.35 ELSE 0 END + CASE WHEN phones <= 1 THEN 0.25 ELSE 0 END, 2) END::DOUBLE AS confidence,
      claims < 2 OR (names <= 1 AND websites <= 1 AND phones <= 1) AS same_entity FROM t"""
)
def entity_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 over every fourth order only: do an entity's sources agree on its name, site and phone? entity_agreement_all takes all."""
    return V.agreement(_claims(A.table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0")), "company_id")


def _claims(orders: DataFrame) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        c.alias("company_id"), F.concat(F.lit("Co"), (c % 7).cast("string")).alias("name"), F.concat(F.lit("https://s"), (o % 2).cast("string"), F.lit(".example")).alias("website"), F.when(o % 3 == 0, "555-01").otherwise("").alias("phone")
    )


@query(
    """WITH c AS (SELECT o_custkey AS company_id, 'Co' || (o_custkey % 7) AS name, 'https://s' || (o_orderkey % 2) || '.example' AS website, CASE WHEN o_orderkey % 3 = 0 THEN '555-01' ELSE '' END AS phone FROM orders),
    t AS (SELECT company_id, count(*) AS claims, count(DISTINCT lower(name)) AS names, count(DISTINCT website) AS websites, count(DISTINCT nullif(regexp_replace(phone, '[^0-9]', '', 'g'), '')) AS phones FROM c GROUP BY 1)
    SELECT company_id, claims, names, websites, phones, CASE WHEN claims < 2 THEN 0.6 ELSE round(CASE WHEN names <= 1 THEN 0.4 ELSE 0 END + CASE WHEN websites <= 1 THEN 0.35 ELSE 0 END + CASE WHEN phones <= 1 THEN 0.25 ELSE 0 END, 2) END::DOUBLE AS confidence,
      claims < 2 OR (names <= 1 AND websites <= 1 AND phones <= 1) AS same_entity FROM t"""
)
def entity_agreement_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do an entity's sources agree on its name, site and phone? All orders."""
    return V.agreement(_claims(A.table(spark, sf_dir, "orders")), "company_id")


_PEOPLE = [("Ada Example", True), ("Read More", False), ("Ada", False), ("ada example", False), ("Mary-Jane O’Neil", False), ("Jean-Luc Picard", True), ("Acme Holdings", False), ("A B C D E", False)]


@query(_values(_PEOPLE, "name, plausible"))
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that may be a person's."""
    return spark.createDataFrame([(n,) for n, _ in _PEOPLE], "name string").withColumn("plausible", V.plausible_person(F.col("name")))


@query("SELECT l_returnflag AS flag, CASE WHEN l_returnflag = 'A' AND epoch_us(TIMESTAMP '1998-12-01') - epoch_us(l_shipdate) > 1000 * 86400000000 THEN 'SUPPORTED' WHEN l_returnflag = 'A' THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def recency_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was verified long ago is only supported."""
    status = F.when(F.col("l_returnflag") == "A", "VERIFIED").otherwise("UNVERIFIED")
    shown = V.recent(status, F.col("l_shipdate"), 1000, F.lit("1998-12-01").cast("timestamp"))
    return A.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), shown.alias("status")).groupBy("flag", "status").agg(F.count("*").alias("n"))


_STATES = [("tx", "TX"), ("New York", "NY"), (" texas ", "TX"), ("Bavaria", "Bavaria"), (None, None)]


@query(_values(_STATES, "raw, code"))
def state_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of states."""
    return spark.createDataFrame([(s,) for s, _ in _STATES], "raw string").withColumn("code", T.state_code(F.col("raw")))


_CRAWL = [
    ("http://user@www.Acme.example:80/index.html?utm_source=a&x=1#top", "http://acme.example/?x=1", "http://user@www.acme.example:80/index.html?utm_source=a&x=1"), ("https://acme.example:8443/a/?ref=z", "https://acme.example:8443/a/", "https://acme.example:8443/a/?ref=z"),
    ("ftp://acme.example/", "ftp://acme.example/", None), ("https://Acme.example/About/", "https://acme.example/About/", "https://acme.example/about"),
]


@query(_values(_CRAWL, "url, crawl, website"))
def url_crawl_and_source_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl form, and a source row's website."""
    return spark.createDataFrame([(u,) for u, _, _ in _CRAWL], "url string").select("url", U.crawl_url(F.col("url")).alias("crawl"), U.source_website(F.col("url")).alias("website"))


_ROWS = [(1, " Acme ", "https://Acme.example/", "+1 (5)", "A@x.example", True), (2, "", "https://a.example", "", "bad", False), (3, "Co", "nope", None, None, False)]


@query(_values([(1, "Acme", "https://acme.example", "+15", "a@x.example", True), (2, None, "https://a.example", None, None, False), (3, "Co", None, None, None, False)], "id, name, website, phone, email, valid"))
def source_rows_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider rows in normal form, and whether each can be used."""
    rows = spark.createDataFrame([r[:5] for r in _ROWS], "id int, name string, website string, phone string, email string")
    tidy = rows.select("id", F.nullif(F.trim("name"), F.lit("")).alias("name"), U.source_website(F.col("website")).alias("website"), T.source_phone(F.col("phone")).alias("phone"), T.source_email(F.col("email")).alias("email"))
    return tidy.withColumn("valid", F.col("name").isNotNull() & F.col("website").isNotNull())


@query("SELECT id, json_extract_string(tags, '$.name') AS name, coalesce(json_extract_string(tags, '$.website'), json_extract_string(tags, '$.\"contact:website\"')) AS website FROM (VALUES (1, '{\"name\":\"A\",\"contact:website\":\"https://a.example\"}'), (2, '{\"name\":\"B\",\"website\":\"https://b.example\"}'), (3, '{}')) v(id, tags)")
def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map tags, read as a map, with the first key that is there."""
    rows = spark.createDataFrame([(1, '{"name":"A","contact:website":"https://a.example"}'), (2, '{"name":"B","website":"https://b.example"}'), (3, "{}")], "id int, tags string")
    m = F.from_json("tags", "map<string,string>")
    return rows.select("id", F.try_element_at(m, F.lit("name")).alias("name"), F.coalesce(F.try_element_at(m, F.lit("website")), F.try_element_at(m, F.lit("contact:website"))).alias("website"))


@query(_values([("100 Public Street, Austin, TX 78701", "100 Public Street", "Austin", "TX", "78701"), ("nowhere", None, None, None, None)], "raw, street, city, state, zip"))
def address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an address."""
    rows = spark.createDataFrame([("100 Public Street, Austin, TX 78701",), ("nowhere",)], "raw string")
    return rows.select("raw", *T.address_parts(F.col("raw")))


@query("SELECT page_id, regexp_extract(host, '(linkedin|facebook|instagram|youtube|twitter|x)\\.com$', 1) AS platform, link FROM (SELECT page_id, 'https://www.' || p || '.com/co' || page_id AS link, p || '.com' AS host FROM pages, (VALUES ('linkedin'), ('x'), ('acme')) v(p)) WHERE regexp_matches(host, '^(linkedin|facebook|instagram|youtube|twitter|x)\\.com$')")
def social_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to social networks among a page's links."""
    pages = A.table(spark, sf_dir, "pages")
    made = F.concat(F.col("html"), *(F.concat(F.lit(f'<a href="https://www.{p}.com/co'), F.col("page_id").cast("string"), F.lit('">x</a>')) for p in ("linkedin", "x", "acme")))
    links = pages.select("page_id", F.explode(H.hrefs(made)).alias("link"))
    return links.select("page_id", H.social_platform(U.host(F.col("link"))).alias("platform"), "link").filter("platform IS NOT NULL")


@query("SELECT doc_id, len(list_filter([1, 2, 3, doc_id], lambda x: list_contains([2, 3, 5], x))) AS kept, len(list_filter([1, 2, 3, doc_id], lambda x: list_contains([2, 3, 5], x))) > 0 AS backed FROM labels")
def citation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids among given ones; citations_backed joins them with stored evidence."""
    cited = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"), F.col("doc_id"))
    kept = F.size(F.filter(cited, lambda x: F.array_contains(F.array(F.lit(2).cast("long"), F.lit(3).cast("long"), F.lit(5).cast("long")), x))).cast("long")
    return A.table(spark, sf_dir, "labels").select("doc_id", kept.alias("kept"), (kept > 0).alias("backed"))


@query("SELECT c_custkey AS id, sha256(lower(c_name) || '|co' || (c_custkey % 400) || '.example')[1:40] AS candidate_id FROM customer")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made from a name and a host."""
    k = F.col("c_custkey")
    site = U.host(F.concat(F.lit("https://www.Co"), (k % 400).cast("string"), F.lit(".example/")))
    return A.table(spark, sf_dir, "customer").select(k.alias("id"), F.substring(F.sha2(F.concat(F.lower("c_name"), F.lit("|"), site), 256), 1, 40).alias("candidate_id"))


@query(_values([("Real-Estate  Firms, TEXAS!", "real estate firms texas"), ("Büro & Co", "büro co")], "raw, signature"))
def query_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes two queries one."""
    return spark.createDataFrame([("Real-Estate  Firms, TEXAS!",), ("Büro & Co",)], "raw string").withColumn("signature", T.query_signature(F.col("raw")))


@query("SELECT s_suppkey AS id, coalesce(list_position(['FOUNDER', 'CEO', 'OWNER'], r), 99)::BIGINT AS priority FROM (SELECT s_suppkey, ['OWNER', 'CEO', 'MANAGER', 'FOUNDER'][s_suppkey % 4 + 1] AS r FROM supplier) ORDER BY priority, id LIMIT 30")
def role_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 contacts by the place of their role among the wanted ones. role_priority_all has all."""
    return role_priority_all(spark, sf_dir).limit(30)


@query("SELECT s_suppkey AS id, coalesce(list_position(['FOUNDER', 'CEO', 'OWNER'], r), 99)::BIGINT AS priority FROM (SELECT s_suppkey, ['OWNER', 'CEO', 'MANAGER', 'FOUNDER'][s_suppkey % 4 + 1] AS r FROM supplier) ORDER BY priority, id")
def role_priority_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contacts, by the place of their role among the wanted ones."""
    role = F.get(F.array(*map(F.lit, ("OWNER", "CEO", "MANAGER", "FOUNDER"))), (F.col("s_suppkey") % 4).cast("int"))
    place = F.array_position(F.array(*map(F.lit, ("FOUNDER", "CEO", "OWNER"))), role)
    rows = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(place == 0, 99).otherwise(place).cast("long").alias("priority"))
    return rows.orderBy("priority", "id")
