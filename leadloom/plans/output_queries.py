"""Model output, groups of duplicates, rate limits and searches of leads as registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import duplicate_groups, lead_search, scoring, size_pages
from leadloom.operators.lead_search import LeadSearch
from leadloom.operators.model_output import backed, classifications, company_lists
from leadloom.plans.entities_sql import COMPANIES, EVIDENCE, LATEST_SCORES, SCORES, VERIFICATIONS, with_
from leadloom.sources import adapters as A
from leadloom.streaming import rates

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as classifications that a model wrote: (id, known, content), of twelve that follow each other each with a fault, a wrapping or neither."""
    k = F.col("c_custkey")
    at = k % 12
    ref = F.array(F.struct(F.concat(F.lit("e"), (k % 4).cast("string")).alias("evidenceId"), F.lit("said so").alias("reason")))
    one = {
        "decision": F.when(at == 1, "PERHAPS").otherwise(F.get(F.array(F.lit("QUALIFIED"), F.lit("NOT_QUALIFIED")), (k % 2).cast("int"))), "confidence": F.when(at == 2, F.lit(1.5)).otherwise((k % 100) / 100), "category": F.when(at != 3, F.lower("c_mktsegment")),
        "investorType": F.when(at == 4, "DENTIST").otherwise("Fix & Flip"), "reasons": F.array(F.lit("reads so")), "positiveEvidence": ref, "negativeEvidence": F.array().cast("array<string>"), "missingEvidence": F.array().cast("array<string>"),
        "locationStatus": F.when(at == 5, "maybe").otherwise("found"),
    }
    written = F.to_json(F.struct(*(v.alias(n) for n, v in one.items())))
    content = (
        F.when(at == 6, F.lit("")).when(at == 7, F.substring(written, 1, 40)).when(at == 8, F.concat(F.lit("```json\n"), written, F.lit("\n```"))).when(at == 9, F.concat(F.lit("I think: "), written, F.lit(" - done")))
        .when(at == 10, F.concat(F.lit('{"classification": '), written, F.lit("}"))).otherwise(written)
    )
    return A.table(spark, sf_dir, "customer").select(k.alias("id"), F.array(F.lit("e0"), F.lit("e1")).alias("known"), content.alias("content"))


@query(
    """WITH t AS (SELECT c_custkey AS id, c_custkey % 12 AS at, c_custkey % 2 = 0 AS yes, c_custkey % 4 < 2 AS known, (c_custkey % 100) / 100 AS confidence, lower(c_mktsegment) AS category,
      CASE c_custkey % 12 WHEN 1 THEN 'INVALID_ENUM: decision' WHEN 2 THEN 'INVALID_SCHEMA: confidence' WHEN 3 THEN 'MISSING_REQUIRED_FIELD: category' WHEN 4 THEN 'INVALID_ENUM: investorType' WHEN 5 THEN 'INVALID_SCHEMA: locationStatus' WHEN 6 THEN 'EMPTY_RESPONSE' WHEN 7 THEN 'INVALID_JSON' END AS error FROM customer)
    SELECT id, error, CASE WHEN error IS NULL THEN CASE WHEN yes AND known THEN 'QUALIFIED' WHEN yes THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NOT_QUALIFIED' END END AS decision, CASE WHEN error IS NULL THEN confidence END AS confidence,
      CASE WHEN error IS NULL THEN category END AS category, CASE WHEN error IS NULL THEN 'FIX_AND_FLIP' END AS investor_type, CASE WHEN error IS NULL THEN known::INT END AS evidence, CASE WHEN error IS NULL THEN 'NOT_FOUND' END AS company_size_verification FROM t"""
)
def model_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifications read out of model output, each row a result or the kind of its fault; positive evidence must be known."""
    r = F.col("final")
    rows = classifications(_answers(spark, sf_dir)).withColumn("final", F.when(F.col("error").isNull(), backed(F.col("result"), F.col("known"))))
    return rows.select("id", "error", *(r[x].alias(x) for x in ("decision", "confidence", "category", "investor_type", "company_size_verification")), F.when(r.isNotNull(), F.size(r["positive_evidence"])).alias("evidence"))


def _object(n: Column) -> Column:
    """The JSON of one company, with brackets and quotes in its name; SQL below writes the same."""
    return F.concat(F.lit('{"company_name": "Co \\"'), n, F.lit('\\" [x}", "official_website": "https://co'), n, F.lit('.example", "contacts": [{"full_name": "Ann '), n, F.lit('", "title": "CEO"}]}'))


@query(
    r"""WITH o AS (SELECT s_suppkey AS id, i, '{"company_name": "Co \"' || (s_suppkey * 10 + i) || '\" [x}", "official_website": "https://co' || (s_suppkey * 10 + i) || '.example", "contacts": [{"full_name": "Ann ' || (s_suppkey * 10 + i) || '", "title": "CEO"}]}' AS obj
      FROM supplier, range(1, 4) AS r(i)), e AS (SELECT *, 14 + sum(length(obj) + 2) OVER (PARTITION BY id ORDER BY i) - 2 AS ends, 14 + sum(length(obj) + 2) OVER (PARTITION BY id) - 2 + 2 AS whole FROM o),
    c AS (SELECT *, whole - (id * 7) % whole AS cut FROM e)
    SELECT id, i::INT AS k, 'Co "' || (id * 10 + i) || '" [x}' AS company_name, 'https://co' || (id * 10 + i) || '.example' AS website, 'Ann ' || (id * 10 + i) AS person, CASE WHEN cut >= whole THEN 'json' ELSE 'partial' END AS form FROM c WHERE ends <= cut"""
)
def model_company_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies out of lists in JSON that was cut off at a place of its own for every supplier: those that had been closed."""
    k = F.col("s_suppkey")
    whole = F.concat(F.lit('{"companies":['), F.concat_ws(", ", *(_object((k * 10 + i).cast("string")) for i in (1, 2, 3))), F.lit("]}"))
    rows = A.table(spark, sf_dir, "supplier").select(k.alias("id"), F.substr(whole, F.lit(1), F.length(whole) - k * 7 % F.length(whole)).alias("content"))
    c = F.col("c")
    found = company_lists(rows).select("id", "form", F.posexplode("companies").alias("p", "c"))
    return found.select("id", (F.col("p") + 1).cast("int").alias("k"), c["company_name"].alias("company_name"), c["official_website"].alias("website"), F.get(c["contacts"], F.lit(0))["full_name"].alias("person"), "form")


@query()
def duplicate_group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on neighbouring orders of a customer, in the order of their keys, as pairs in groups; the first tenth is known. Order-dependent, so rows only."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rank"), (F.col("o_orderkey") % 977).alias("record_a"), (F.col("o_custkey") % 977).alias("record_b"), F.col("o_orderpriority").alias("p"))
    status = F.when(F.col("p").startswith("1"), "AUTO_DUPLICATE").when(F.col("p").startswith("5"), "PENDING").otherwise("NEEDS_REVIEW")
    kind = F.when(F.col("p").startswith("1"), "EXACT_MATCH").when(F.col("p").startswith("5"), "NO_MATCH").otherwise("POSSIBLE_MATCH")
    decided = o.select("rank", "record_a", "record_b", F.when(F.col("rank") % 2 == 0, F.col("record_a")).otherwise(F.col("record_b")).alias("master"), status.alias("status"), kind.alias("match_type"), F.lit(0.5).alias("confidence"))
    known = decided.filter("rank % 10 = 0 AND status <> 'PENDING'").select(F.least("record_a", "record_b").alias("a"), F.greatest("record_a", "record_b").alias("b")).distinct()
    groups = spark.createDataFrame([], "canonical long, created long")
    return duplicate_groups.assign(decided, known, groups)[0]


#: Requests that a minute, an hour and a day let pass.
LIMITS = {"minute": 1, "hour": 2, "day": 4}


@query(
    """WITH RECURSIVE s AS (SELECT (user_id % 5)::INT AS org_id, (user_id % 10)::VARCHAR AS user_id, event_type AS operation, floor(epoch(ts))::BIGINT AS second, count(*) AS hits FROM events WHERE ts IS NOT NULL GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY org_id, user_id, operation ORDER BY second) AS k FROM s),
    r AS (
      SELECT org_id, user_id, operation, 0::BIGINT AS k, 0::BIGINT AS second, 0::BIGINT AS hits, 0::BIGINT AS ms, 0::BIGINT AS mc, 0::BIGINT AS hs, 0::BIGINT AS hc, 0::BIGINT AS ds, 0::BIGINT AS dc, 0::BIGINT AS p1, 0::BIGINT AS p2, 0::BIGINT AS p3 FROM (SELECT DISTINCT org_id, user_id, operation FROM n)
      UNION ALL
      SELECT org_id, user_id, operation, k, second, hits, ms, mc0 + hits, hs, hc0 + p1, ds, dc0 + p2, p1, p2, greatest(0, least(p2, 4 - dc0)) FROM (
        SELECT *, greatest(0, least(p1, 2 - hc0)) AS p2, CASE WHEN least(p1, 2 - hc0) > 0 AND (odc = 0 OR second >= ods + 86400) THEN second ELSE ods END AS ds, CASE WHEN least(p1, 2 - hc0) > 0 AND (odc = 0 OR second >= ods + 86400) THEN 0 ELSE odc END AS dc0 FROM (
          SELECT *, greatest(0, least(hits, 1 - mc0)) AS p1, CASE WHEN least(hits, 1 - mc0) > 0 AND (ohc = 0 OR second >= ohs + 3600) THEN second ELSE ohs END AS hs, CASE WHEN least(hits, 1 - mc0) > 0 AND (ohc = 0 OR second >= ohs + 3600) THEN 0 ELSE ohc END AS hc0 FROM (
            SELECT n.org_id, n.user_id, n.operation, n.k, n.second, n.hits, r.hs AS ohs, r.hc AS ohc, r.ds AS ods, r.dc AS odc, CASE WHEN r.mc = 0 OR n.second >= r.ms + 60 THEN n.second ELSE r.ms END AS ms, CASE WHEN r.mc = 0 OR n.second >= r.ms + 60 THEN 0 ELSE r.mc END AS mc0
            FROM r JOIN n ON n.org_id = r.org_id AND n.user_id = r.user_id AND n.operation = r.operation AND n.k = r.k + 1)))
    ) SELECT org_id, user_id, operation, second, hits, p3 AS allowed, hits - p1 AS refused_minute, p1 - p2 AS refused_hour, p2 - p3 AS refused_day FROM r WHERE k > 0"""
)
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What windows of a minute, an hour and a day that open with their first hit let pass and refuse, by organisation, user and operation."""
    e = A.table(spark, sf_dir, "events")
    return rates.limited(e.select((F.col("user_id") % 5).cast("int").alias("org_id"), (F.col("user_id") % 10).alias("user_id"), F.col("event_type").alias("operation"), F.col("ts").alias("created_at")), LIMITS)


def _lead_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Companies with their children: customers, and their orders and lines as contacts, places, classifications and so on."""
    companies = A.companies(spark, sf_dir)
    k, o = F.col("id"), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    whole = companies.withColumns({
        "description": F.when(k % 6 == 0, F.concat(F.lit("Buys homes near lake "), (k % 9).cast("string"))), "investor_type": F.when(k % 4 == 0, "FIX_AND_FLIP"), "investment_strategy": F.when(k % 2 == 0, "Buy and hold"), "property_types": F.array(F.lit("Land"), F.concat(F.lit("T"), (k % 3).cast("string"))),
        "markets_served": F.array(F.concat(F.lit("M"), (k % 5).cast("string"))), "updated_at": F.timestamp_seconds(F.lit(978307200) + k % 77 * 86400), "last_verified_at": F.when(k % 3 > 0, F.timestamp_seconds(F.lit(988307200) + k % 55 * 86400)),
    })
    orders = A.table(spark, sf_dir, "orders").join(companies.select(F.col("id").alias("o_custkey"), "org_id"), "o_custkey").withColumnRenamed("o_custkey", "company_id")
    pick = lambda values, key: F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))
    return {
        "companies": whole, "scores": A.scores(spark, sf_dir), "verifications": A.verifications(spark, sf_dir).join(companies.select(F.col("id").alias("company_id"), "org_id"), "company_id"),
        "sources": orders.select("org_id", "company_id", F.date_format("o_orderdate", "yyyy-MM").alias("execution_id")),
        "classifications": orders.select("org_id", "company_id", pick(("QUALIFIED", "NOT_QUALIFIED", "INSUFFICIENT_EVIDENCE"), o).alias("decision"), (o % 100 / 100).alias("confidence")),
        "contacts": orders.select("company_id", pick(("CEO and Founder", "Office Manager", None), o).alias("title"), F.when(o % 5 > 0, "Ann B").alias("full_name"), F.when(o % 2 == 0, "https://l.example").alias("linkedin_url"), none.alias("facebook_url"), none.alias("instagram_url"), pick(("VERIFIED", "FOUND", None), F.floor(o / 2)).alias("verification_status"), none.alias("email_status")),
        "locations": companies.select(F.col("id").alias("company_id"), "state", pick(("Austin", "Dallas", None), k).alias("city"), pick(("US", "Germany"), k).alias("country"), (k % 90).cast("string").alias("postal_code")),
        "duplicates": orders.select("org_id", F.lit("COMPANY").alias("entity_type"), F.col("company_id").alias("entity_a_id"), pick(("NEEDS_REVIEW", "AUTO_DUPLICATE"), o).alias("status")),
        "qualifications": orders.select("org_id", "company_id", F.date_format("o_orderdate", "yyyy-MM").alias("execution_id"), pick(("QUALIFIED", "NEEDS_REVIEW"), F.floor(o / 3)).alias("status")),
    }


@query(
    with_(COMPANIES, SCORES, LATEST_SCORES, VERIFICATIONS)
    + """, o AS (SELECT *, o_custkey AS company_id FROM orders), found AS (
      SELECT id, name FROM companies WHERE org_id = 1 AND website ILIKE '%co%' AND website ILIKE '%.example%' AND id % 2 = 0 AND (name ILIKE '%lake%' OR website ILIKE '%lake%' OR (id % 6 = 0 AND 'Buys homes near lake ' || (id % 9) ILIKE '%lake%'))
        AND id IN (SELECT company_id FROM o WHERE o_orderkey % 3 = 0 AND o_orderkey % 100 / 100 >= 0.1) AND id IN (SELECT company_id FROM latest_scores WHERE score <= 95) AND id IN (SELECT company_id FROM verifications WHERE status = 'VERIFIED' AND checked_at >= TIMESTAMP '1990-01-01')
        AND id IN (SELECT company_id FROM o WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 > 0 AND (o_orderkey // 2) % 3 = 0) AND id % 3 = 0 AND id % 2 = 0 AND id IN (SELECT company_id FROM o WHERE o_orderkey % 2 = 1) AND id IN (SELECT company_id FROM o WHERE (o_orderkey // 3) % 2 = 0))
    SELECT id, name, coalesce(score, -1) AS score, (SELECT count(*) FROM found) AS total, ceil((SELECT count(*) FROM found) / 10.0)::BIGINT AS total_pages FROM found LEFT JOIN latest_scores ON company_id = id ORDER BY name, id LIMIT 10"""
)
def lead_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads by texts, places, and six facets of their children in one exchange, by name."""
    asked = LeadSearch(
        1, limit=10, sort_by="company_name", sort_order="asc", search="lake", website=".example", domain="co", investment_strategy="hold", property_type="land", classification="QUALIFIED", classification_confidence=0.1, max_score=95, verification_status="VERIFIED",
        last_verified_from="1990-01-01", contact_title="founder", has_decision_maker=True, has_verified_contact=True, city="austin", country="us", duplicate_status="AUTO_DUPLICATE", qualification_status="QUALIFIED",
    )
    return lead_search.search(_lead_tables(spark, sf_dir), asked).select("id", "name", "score", "total", "total_pages")


@query(
    with_(COMPANIES, SCORES, LATEST_SCORES)
    + """ SELECT s.id, s.org_id, coalesce(l.score, -1) AS score, s.updated_at FROM (
      SELECT id, org_id, make_timestamp((978307200 + id % 77 * 86400) * 1000000) AS updated_at FROM companies WHERE org_id = 2 AND id % 4 = 0 AND (email IS NULL OR length(trim(email)) = 0)
        AND id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 0)) s LEFT JOIN latest_scores l ON l.company_id = s.id ORDER BY updated_at DESC, s.id LIMIT 7"""
)
def leads_recently_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of one investor type without an e-mail and with an unnamed, unlinked contact, newest first."""
    asked = LeadSearch(2, limit=7, sort_by="updated_at", investor_type="FIX_AND_FLIP", has_email=False, has_linkedin=False, has_decision_maker=False)
    return lead_search.search(_lead_tables(spark, sf_dir), asked).select("id", "org_id", "score", "updated_at")


_POINTS = "CASE {0} WHEN 'VERIFIED' THEN {1} WHEN 'SUPPORTED' THEN {2} WHEN 'CONFLICT' THEN -{2} WHEN 'NEEDS_REVIEW' THEN -{2} ELSE 0 END"
_FIRST = "first(status ORDER BY id, checked_at, status) FILTER (WHERE field = '{0}') AS {0}"


@query(
    with_(COMPANIES, VERIFICATIONS, EVIDENCE)
    + f""", leads AS (SELECT *, CASE id % 4 WHEN 0 THEN 'QUALIFIED' WHEN 1 THEN 'NOT_QUALIFIED' WHEN 2 THEN 'INSUFFICIENT_EVIDENCE' END AS decision, id % 2 = 0 AS investor, id % 3 > 0 AS has_contact FROM companies),
    f AS (SELECT company_id, {", ".join(_FIRST.format(x) for x in ("companyName", "website", "state", "title", "email", "phone", "companySize"))}, count(*) FILTER (WHERE status IN ('CONFLICT', 'NEEDS_REVIEW')) AS bad,
      coalesce(array_to_string(list_sort(list_distinct(list(field || ':' || status) FILTER (WHERE status IN ('CONFLICT', 'NEEDS_REVIEW')))), ','), '') AS conflicts FROM verifications GROUP BY 1),
    e AS (SELECT company_id, max(retrieved_at) AS newest, count(DISTINCT evidence_type) AS kinds, bool_or(id % 50 = 0) AS acquires FROM evidence GROUP BY 1),
    t AS (SELECT l.*, coalesce(conflicts, '') AS conflicts, greatest(0, least(100, CASE decision WHEN 'QUALIFIED' THEN 25 WHEN 'NOT_QUALIFIED' THEN -25 WHEN 'INSUFFICIENT_EVIDENCE' THEN 5 ELSE 0 END + CASE WHEN investor AND acquires THEN 15 ELSE 0 END
      + {_POINTS.format("companyName", 10, 5)} + {_POINTS.format("f.website", 8, 4)} + {_POINTS.format("f.state", 7, 4)} + {_POINTS.format("companySize", 2, 1)} + CASE WHEN has_contact THEN {_POINTS.format("title", 5, 3)} + {_POINTS.format("f.email", 4, 2)} + {_POINTS.format("f.phone", 2, 1)} ELSE 0 END
      + CASE WHEN newest IS NULL THEN 0 WHEN epoch_us(TIMESTAMP '2000-01-01') - epoch_us(newest) <= 30 * 86400000000 THEN 3 WHEN epoch_us(TIMESTAMP '2000-01-01') - epoch_us(newest) <= 180 * 86400000000 THEN 2 ELSE 1 END + least(3, coalesce(kinds, 0)) - CASE WHEN bad > 0 THEN 10 ELSE 0 END))::INT AS score,
      3 + (coalesce(employee_count::VARCHAR, employee_range, '') <> '')::INT + has_contact::INT + CASE WHEN investor THEN (id % 4 = 0)::INT + has_contact::INT ELSE 0 END AS available
      FROM leads l LEFT JOIN f ON f.company_id = l.id LEFT JOIN e ON e.company_id = l.id)
    SELECT id AS company_id, score, CASE WHEN score < 40 THEN 'LOW' WHEN score < 70 THEN 'MEDIUM' WHEN score < 85 THEN 'HIGH' ELSE 'VERY_HIGH' END AS band, available AS available_fields, CASE WHEN investor THEN 11 ELSE 8 END AS expected_fields,
      floor(available * 100 / CASE WHEN investor THEN 11.0 ELSE 8.0 END + 0.5)::INT AS completeness, conflicts, (CASE WHEN investor THEN 13 ELSE 9 END + CASE WHEN has_contact THEN 4 ELSE 0 END)::INT AS n_signals FROM t"""
)
def lead_score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with all their signals and completeness, each lead by the mode of its own plan, the first verification of a field counting."""
    k = F.col("id")
    contact = k % 3 > 0
    none = F.lit(None).cast("string")
    leads = A.companies(spark, sf_dir).select(
        k.alias("company_id"), F.get(F.array(F.lit("QUALIFIED"), F.lit("NOT_QUALIFIED"), F.lit("INSUFFICIENT_EVIDENCE"), none), (k % 4).cast("int")).alias("decision"), F.when(k % 2 == 0, "investor").otherwise("company").alias("mode"), contact.alias("has_contact"),
        "name", "website", none.alias("description"), "phone", F.coalesce(F.col("employee_count").cast("string"), "employee_range").alias("size"), F.when(contact, "Ann B").alias("full_name"), F.when(contact, "CEO").alias("title"), none.alias("linkedin_url"), none.alias("contact_email"),
        none.alias("contact_phone"), F.when(k % 4 == 0, "Buy and hold").alias("investment_strategy"), F.lit(False).alias("has_markets"), F.lit(True).alias("has_property_types"),
    )
    fields = A.verifications(spark, sf_dir).select("company_id", "field", "status", F.lit(None).cast("string").alias("evidence_id"), F.struct("id", "checked_at", "status").alias("rank"))
    rows = A.evidence(spark, sf_dir).withColumn("evidence_text", F.concat("value", F.when(F.col("id") % 50 == 0, " rental").otherwise("")))
    found = scoring.breakdowns(leads, fields, rows, F.lit("2000-01-01").cast("timestamp"))
    return found.select("company_id", "score", "band", "available_fields", "expected_fields", "completeness", F.array_join("conflicts", ",").alias("conflicts"), F.size("signals").alias("n_signals"))


def _size_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as companies with four pages each: their own, a directory's, one on another organisation, one that does not name them."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    suppliers = A.table(spark, sf_dir, "supplier")
    companies = suppliers.select(k.alias("company_id"), F.concat(F.lit("Oak"), n, F.lit(" Stream, LLC")).alias("name"), F.concat(F.lit("https://www.oak"), n, F.lit(".example")).alias("website"), F.when(k % 3 > 0, "Austin").alias("city"), F.when(k % 3 == 0, "TX").alias("state"))
    low = k % 20 + 11
    page = lambda rank, url, title, text: F.struct(F.lit(rank).alias("rank"), url.alias("url"), title.alias("title"), text.alias("text"))
    own = F.concat(F.lit("Oak"), n)
    listed = F.array(
        page(1, F.concat(F.lit("https://oak"), n, F.lit(".example/about")), F.lit("About us"), F.concat(own, F.lit(" Stream builds homes along the quiet river. Company size: "), low.cast("string"), F.lit("-60 employees"))),
        page(2, F.lit("https://dir.example/oak"), F.concat(own, F.lit(" Stream")), F.concat(F.lit("In Austin, Texas. "), own, F.lit(" Stream has "), F.when(k % 4 == 0, k % 100 + 100).otherwise(low + 1).cast("string"), F.lit(" employees"))),
        page(3, F.lit("https://news.example/x"), F.lit("Austin news"), F.concat(own, F.lit(" Stream Capital Partners LLC of Texas has 9000 employees"))),
        page(4, F.lit("https://other.example"), F.lit("Austin"), F.lit("Elm Realty of Texas has 7 employees")),
    )
    return companies, suppliers.select(k.alias("company_id"), F.explode(listed).alias("p")).select("company_id", "p.*")


@query(
    """SELECT s_suppkey AS company_id, rank, CASE rank WHEN 3 THEN 'ANOTHER_ORGANISATION' WHEN 4 THEN 'NOT_NAMED' END AS refused, CASE WHEN rank = 1 THEN 'range' ELSE 'exact' END AS kind FROM supplier, (VALUES (1), (2), (3), (4)) v(rank)"""
)
def size_page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that state a size, and why some are not about the company."""
    return size_pages.findings(*_size_pages(spark, sf_dir)).select("company_id", "rank", "refused", "kind")


@query(
    """SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 4 = 0 THEN 'conflict' ELSE 'value' END AS outcome, (CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 20 + 11 ELSE s_suppkey % 20 + 12 END)::INT AS low, (CASE WHEN s_suppkey % 4 = 0 THEN 60 ELSE s_suppkey % 20 + 12 END)::INT AS high,
      (CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 100 + 100 END)::INT AS other_low FROM supplier"""
)
def size_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One size for each company out of its pages, or the two that conflict."""
    return size_pages.assess(size_pages.findings(*_size_pages(spark, sf_dir))).select("company_id", "outcome", "low", "high", "other_low")
