"""Queries over identities, people, stages and claims that only texts bear out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import evidence as E
from leadloom.operators import identity as I
from leadloom.operators import places as P
from leadloom.operators.relational import page
from leadloom.plans.entities_sql import COMPANIES, EVENTS, EVIDENCE, SOURCES, with_
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
    """WITH stored AS (SELECT c_custkey AS id, 'x' || c_custkey AS external_id, 'w' || (c_custkey % 700) AS website, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'n' || (c_custkey % 300) END AS name, CASE c_custkey % 3 WHEN 0 THEN 'Austin' WHEN 1 THEN 'Dallas' END AS city FROM customer),
    found AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'x' || (o_orderkey // 5 % 2000) END AS external_id, CASE WHEN o_orderkey % 3 = 0 THEN 'W' || (o_orderkey % 900) ELSE ' ' END AS website, 'N' || (o_orderkey % 310) AS name, CASE o_orderkey % 4 WHEN 0 THEN 'austin ' WHEN 1 THEN 'Dallas' END AS city FROM orders),
    s AS (SELECT id, city, 0 AS rank, lower(trim(external_id)) AS key FROM stored UNION ALL SELECT id, city, 1, lower(trim(website)) FROM stored UNION ALL SELECT id, city, 2, lower(trim(name)) FROM stored),
    f AS (SELECT id, city, 0 AS rank, lower(trim(external_id)) AS key FROM found UNION ALL SELECT id, city, 1, lower(trim(website)) FROM found UNION ALL SELECT id, city, 2, lower(trim(name)) FROM found)
    SELECT f.id, arg_min(s.id, (f.rank, s.id)) AS company_id, (['external_id', 'website', 'name'])[min(f.rank) + 1] AS key FROM f JOIN s USING (rank, key) WHERE key <> '' AND (f.city IS NULL OR s.city IS NULL OR lower(trim(f.city)) = lower(trim(s.city))) GROUP BY f.id"""
)
def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored company a found one is, by its strongest key that fits."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    none = F.lit(None).cast("double")
    text = lambda lead, k: F.concat(F.lit(lead), k.cast("string"))
    stored = A.table(spark, sf_dir, "customer").select(
        c.alias("id"), text("x", c).alias("external_id"), text("w", c % 700).alias("website"), F.when(c % 4 == 0, "").otherwise(text("n", c % 300)).alias("name"), F.when(c % 3 == 0, "Austin").when(c % 3 == 1, "Dallas").alias("city"), none.alias("lat"), none.alias("lon")
    )
    found = A.table(spark, sf_dir, "orders").select(
        o.alias("id"), F.when(o % 5 == 0, text("x", F.floor(o / 5) % 2000)).alias("external_id"), F.when(o % 3 == 0, text("W", o % 900)).otherwise(" ").alias("website"), text("N", o % 310).alias("name"),
        F.when(o % 4 == 0, "austin ").when(o % 4 == 1, "Dallas").alias("city"), none.alias("lat"), none.alias("lon"),
    )
    return I.lookup(found, stored, ["external_id", "website", "name"])


@query(
    """WITH p AS (SELECT l_suppkey % 50 AS company, (['Ann', ' ann', 'Bob'])[l_partkey % 3 + 1] || ' P' || (l_partkey % 40) AS name, CASE WHEN l_quantity > 45 THEN 'm' || l_orderkey END AS email, CASE WHEN l_quantity < 3 THEN 'p' || l_orderkey ELSE '' END AS phone, l_orderkey * 10 + l_linenumber AS n FROM lineitem)
    SELECT arg_min(name, n) AS name, arg_min(company, n) AS company, arg_min(email, n) FILTER (WHERE coalesce(trim(email), '') <> '') AS email, arg_min(phone, n) FILTER (WHERE trim(phone) <> '') AS phone, count(*) AS n FROM p GROUP BY company, lower(trim(name))"""
)
def people_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found people of one name at one company as one, empty fields filled in order."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    name = F.concat(F.get(F.array(F.lit("Ann"), F.lit(" ann"), F.lit("Bob")), (F.col("l_partkey") % 3).cast("int")), F.lit(" P"), (F.col("l_partkey") % 40).cast("string"))
    people = A.table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("company"), name.alias("name"), F.when(F.col("l_quantity") > 45, F.concat(F.lit("m"), F.col("l_orderkey").cast("string"))).alias("email"), F.when(F.col("l_quantity") < 3, F.concat(F.lit("p"), F.col("l_orderkey").cast("string"))).otherwise("").alias("phone"), key.alias("seq")
    )
    return I.fold_people(people, ["name", "company"], ["email", "phone"], ["seq"])


@query(
    with_(EVENTS)
    + """, e AS (SELECT user_id % 30 AS run, operation AS stage, (['started', 'completed', 'waited'])[event_id % 3 + 1] AS kind, event_id * 1000 AS at_ms, coalesce(quantity, 0) - 5 AS wait_ms FROM usage_events),
    s AS (SELECT run, stage, min(at_ms) FILTER (WHERE kind = 'started') AS a, max(at_ms) FILTER (WHERE kind = 'started') AS z, max(at_ms) FILTER (WHERE kind = 'completed') AS c, count(*) FILTER (WHERE kind = 'started') AS batches FROM e GROUP BY 1, 2),
    w AS (SELECT e.run, e.stage, sum(greatest(0, wait_ms))::BIGINT AS waiting FROM e JOIN s USING (run, stage) WHERE kind = 'waited' AND at_ms >= a GROUP BY 1, 2)
    SELECT run, stage, coalesce(a, c) AS started_at, CASE WHEN c >= coalesce(z, c) THEN c END AS completed_at, CASE WHEN c >= coalesce(z, c) THEN greatest(0, c - coalesce(a, c)) END AS duration_ms, coalesce(waiting, 0) AS waiting_ms, batches FROM s LEFT JOIN w USING (run, stage)"""
)
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When stages of runs began and ended, how long they took and waited."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "started").when(e % 3 == 1, "completed").otherwise("waited")
    events = A.usage_events(spark, sf_dir).select((F.col("user_id") % 30).alias("run"), F.col("operation").alias("stage"), kind.alias("kind"), (e * 1000).alias("at_ms"), (F.coalesce("quantity", F.lit(0)) - 5).cast("long").alias("wait_ms"))
    return I.stage_progress(events, ["run", "stage"])


@query(
    with_(EVENTS)
    + """, t AS (SELECT user_id, count(*) AS found, count(*) FILTER (WHERE operation = 'purchase') AS verified, CASE WHEN user_id % 3 = 0 THEN 'PENDING' ELSE 'DONE' END AS discovery, CASE WHEN user_id % 2 = 0 THEN 'PENDING' ELSE 'RUNNING' END AS verification FROM usage_events GROUP BY user_id)
    SELECT user_id, CASE WHEN discovery <> 'PENDING' THEN found END AS found, CASE WHEN verification <> 'PENDING' THEN verified END AS verified, found + 0 AS requested FROM t"""
)
def masked_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of runs that show only once their stage has begun."""
    u = F.col("user_id")
    runs = A.usage_events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("operation") == "purchase").alias("v"))
    runs = runs.withColumns({"discovery": F.when(u % 3 == 0, "PENDING").otherwise("DONE"), "verification": F.when(u % 2 == 0, "PENDING").otherwise("RUNNING")})
    return runs.select("user_id", *I.masked({"found": F.col("n"), "verified": F.col("v"), "requested": F.col("n")}, {"found": "discovery", "verified": "verification"}))


@query(
    """WITH j AS (SELECT o_custkey AS run, (['completed', 'failed', 'missing', 'active'])[CASE WHEN o_orderkey % 97 = 0 THEN 4 ELSE o_orderkey % 3 % 2 + 1 END] AS state, (['FOUND', 'NOT_FOUND', NULL])[o_orderkey % 3 + 1] AS site FROM orders),
    t AS (SELECT run, count(*) AS jobs, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'active') AS running, count(*) FILTER (WHERE site = 'FOUND') AS found, count(*) FILTER (WHERE site = 'NOT_FOUND') AS without FROM j GROUP BY 1)
    SELECT run, CASE WHEN running > 0 THEN 'PENDING' WHEN failed = jobs THEN 'FAILED' WHEN failed > 0 OR without > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS state, jobs, found FROM t"""
)
def jobs_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state for the jobs of a run, sites that were not found counted in."""
    k = F.col("o_orderkey")
    state = F.when(k % 97 == 0, "active").when(k % 3 % 2 == 0, "completed").otherwise("failed")
    jobs = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), state.alias("state"), F.when(k % 3 == 0, "FOUND").when(k % 3 == 1, "NOT_FOUND").alias("website_status"))
    return I.settled(jobs, ["run"])


_QUERIES = ["acme homes ceo", "ACME Homes CEO email", "acme homes official site", "acme homes website", "ceo", "bee homes founder", "acme homes founder"]


@query(
    f"""WITH q AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(_QUERIES))}) v(i, t)), w AS (SELECT i, list_distinct(list_filter(string_split(lower(t), ' '), lambda x: length(x) >= 3 AND x NOT IN ('official', 'site', 'website'))) AS w FROM q),
    p AS (SELECT a.i AS a, b.i AS b, a.w AS x, b.w AS y, list_filter(a.w, lambda r: r IN ('ceo', 'email', 'founder')) AS m, list_filter(b.w, lambda r: r IN ('ceo', 'email', 'founder')) AS n FROM w a, w b),
    near AS (SELECT a, b, len(x) >= 2 AND len(y) >= 2 AND len(list_intersect(x, y)) >= 2 AND (len(list_intersect(m, n)) > 0 OR (len(m) = 0 AND len(n) = 0)) AS near FROM p)
    SELECT o_orderkey AS id, near FROM orders JOIN near ON a = o_orderkey % 7 AND b = o_orderkey // 7 % 7"""
)
def query_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that ask again what one before asked."""
    k = F.col("o_orderkey")
    pick = lambda i: F.get(F.array(*map(F.lit, _QUERIES)), (i % len(_QUERIES)).cast("int"))
    return A.table(spark, sf_dir, "orders").select(k.alias("id"), I.near_duplicate_query(pick(k), pick(F.floor(k / 7))).alias("near"))


@query(
    with_(EVIDENCE)
    + """, x AS (SELECT company_id, id, CASE WHEN id % 7 = 0 THEN 'We do not ever buy homes' WHEN id % 5 = 0 THEN 'We Buy homes for cash ' || (id % 100) ELSE 'nothing here' END AS text, source_url AS url FROM evidence)
    SELECT company_id, arg_min(text, (id, text, coalesce(url, '-'))) AS text, arg_min(coalesce(url, '-'), (id, text, coalesce(url, '-'))) AS url FROM x WHERE regexp_matches(text, '(?i)\\bbuy homes') AND NOT regexp_matches(text, '(?i)do not') GROUP BY 1"""
)
def first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first piece of evidence of each company that speaks of purchases and does not deny them."""
    i = F.col("id")
    text = F.when(i % 7 == 0, "We do not ever buy homes").when(i % 5 == 0, F.concat(F.lit("We Buy homes for cash "), (i % 100).cast("string"))).otherwise("nothing here")
    rows = A.evidence(spark, sf_dir).select("company_id", "id", text.alias("text"), F.coalesce("source_url", F.lit("-")).alias("url"))
    return I.first_match(rows, ["company_id"], r"(?i)\bbuy homes", "id", affirmed=True)


@query(
    with_(EVIDENCE)
    + """, stored AS (SELECT DISTINCT company_id, field, 'Phrase ' || (company_id % 9) AS value FROM evidence WHERE company_id % 2 = 0 AND field <> 'phone'), none AS (SELECT * FROM evidence WHERE company_id % 4 = 0),
    x AS (SELECT company_id, 'they say phrase ' || (id % 9) || ' often' AS text, CASE WHEN source_url IS NULL THEN 'provider:' || provider ELSE 'domain:example.co.uk' END AS source FROM evidence),
    c AS (SELECT company_id, field, count(DISTINCT lower(trim(value))) AS n FROM none GROUP BY 1, 2),
    t AS (SELECT s.company_id, s.field, count(DISTINCT source) AS k FROM stored s JOIN x ON x.company_id = s.company_id AND contains(x.text, lower(s.value)) GROUP BY 1, 2)
    SELECT s.company_id, s.field, CASE WHEN c.n > 1 THEN 'NEEDS_REVIEW' WHEN coalesce(k, 0) >= 2 THEN 'VERIFIED' WHEN k = 1 THEN 'SUPPORTED' ELSE 'UNVERIFIED' END AS status, CASE WHEN c.n > 1 THEN 0 ELSE coalesce(k, 0) END AS source_count FROM stored s LEFT JOIN c USING (company_id, field) LEFT JOIN t USING (company_id, field)"""
)
def claims_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values (no numbers) that no claim repeats, from the independent sources whose texts have them."""
    rows = A.evidence(spark, sf_dir)
    k = F.col("company_id")
    stored = rows.filter((k % 2 == 0) & (F.col("field") != "phone")).select("company_id", "field").distinct().withColumn("value", F.concat(F.lit("Phrase "), (k % 9).cast("string")))
    excerpts = rows.select("company_id", F.concat(F.lit("they say phrase "), (F.col("id") % 9).cast("string"), F.lit(" often")).alias("text"), "source_url", "provider")
    return E.reconcile(rows.filter(k % 4 == 0), stored, excerpts).select("company_id", "field", "status", "source_count")


@query(
    with_(COMPANIES, SOURCES)
    + """, places AS (SELECT o_custkey AS company_id, o_orderkey AS id, o_orderdate AS created_at, o_orderkey % 9 = 0 AS is_primary, 'city' || (o_orderkey % 50) AS city FROM orders WHERE o_orderkey % 4 > 0),
    main AS (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY is_primary DESC, created_at, id) = 1)
    SELECT r.external_id, c.name, m.city FROM source_records r JOIN companies c ON c.id = r.company_id LEFT JOIN main m ON m.company_id = c.id AND m.is_primary WHERE execution_id = '1996-03' AND c.org_id IN (1, 2) ORDER BY r.external_id LIMIT 20 OFFSET 20"""
)
def candidates_with_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of an execution's candidates with their company and, where there is one, its primary location."""
    k = F.col("o_orderkey")
    records = A.source_records(spark, sf_dir).filter("execution_id = '1996-03'").select("external_id", "company_id")
    companies = A.companies(spark, sf_dir).filter("org_id IN (1, 2)").select(F.col("id").alias("company_id"), "name")
    places = A.table(spark, sf_dir, "orders").filter(k % 4 > 0).select(F.col("o_custkey").alias("company_id"), k.alias("id"), F.col("o_orderdate").alias("created_at"), (k % 9 == 0).alias("is_primary"), F.concat(F.lit("city"), (k % 50).cast("string")).alias("city"))
    found = records.join(companies, "company_id")
    main = P.main_location(A.of_companies(places, found)).select(F.col("company_id").alias("owner"), "location.city", "location.is_primary")
    listed = found.join(main, (F.col("company_id") == F.col("owner")) & F.col("is_primary"), "left")
    return page(listed, [F.asc("external_id")], 2, 20).select("external_id", "name", "city")


@query(
    with_(EVIDENCE)
    + """, cited AS (SELECT doc_id AS decision, unnest([doc_id * 10 + 1, doc_id * 10 + 2, doc_id * 7 + 3, NULL]) AS id FROM labels),
    e AS (SELECT DISTINCT id, trim(value) AS value FROM evidence), j AS (SELECT decision, c.id, count(e.id) AS n FROM cited c LEFT JOIN e USING (id) GROUP BY 1, 2)
    SELECT decision, count(*) FILTER (WHERE n > 0) AS kept, count(*) FILTER (WHERE n = 0 AND id IS NOT NULL) AS dropped, count(*) FILTER (WHERE n > 0) > 0 AS backed FROM j GROUP BY 1"""
)
def citations_backed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cited ids of each decision that are stored evidence; a decision without any is not backed."""
    d = F.col("doc_id")
    decisions = A.table(spark, sf_dir, "labels").select(d.alias("decision"), F.array(d * 10 + 1, d * 10 + 2, d * 7 + 3, F.lit(None).cast("long")).alias("cited"))
    return I.citations(decisions, A.evidence(spark, sf_dir).select("id"))
