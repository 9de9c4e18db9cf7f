"""Queries over discovery, metering and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.operators import discovery as D
from leadloom.operators import export, qualify, usage
from leadloom.operators.relational import page
from leadloom.plans import search_plan
from leadloom.plans.entities_sql import COMPANIES, EVENTS, SCORES, LATEST_SCORES, VERIFICATIONS, LATEST_FIELDS, with_
from leadloom.operators import evidence as E
from leadloom.operators import leads
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


_URLS = ["https://www.facebook.com/x", "https://acme.example/", "ftp://acme.example", "https://acme.example/rankings/10-firms", "https://sub.yelp.com/biz", "acme.example", "https://x.example/blog/a", None, "https://www.sec.gov/x", "https://news.forbes.com/a", "http://not a url"]
_WHY = ["SOCIAL_PROFILE", None, "INVALID_URL", "GENERIC_LIST", "REVIEW_SITE", None, "GENERIC_LIST", None, "PROXY_OR_FILING", "NEWS_ARTICLE", "INVALID_URL"]


_quoted = lambda x: "NULL" if x is None else f"'{x}'"


@query(f"SELECT * FROM (VALUES {', '.join(f'({_quoted(u)}, {_quoted(w)})' for u, w in zip(_URLS, _WHY))}) v(url, reason)")
def url_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a URL is no candidate's own site, case by case; candidate_url_gate does it over a table."""
    return spark.createDataFrame([(u,) for u in _URLS], "url string").withColumn("reason", D.reject_url(F.col("url")))


_DOCS = "SELECT doc_id AS id, 'doc' || (doc_id % 211) AS external_id, 'https://www.S' || (doc_id % 173) || '.example' AS website, doc_id % 10 AS block FROM documents"


@query(f"WITH k AS (SELECT id, unnest(['id:' || external_id, 'website:' || lower(regexp_extract(website, 'www\\.(.*)', 1))]) AS key FROM ({_DOCS})) SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b USING (key) WHERE a.id < b.id")
def discovery_dedupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that share an id, a site, or a name and place."""
    return D.duplicate_pairs(_candidates(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    none = F.lit(None).cast("string")
    keys = D.identity_keys(F.concat(F.lit("doc"), (k % 211).cast("string")), F.concat(F.lit("https://www.S"), (k % 173).cast("string"), F.lit(".example")), none, none, none)
    return A.table(spark, sf_dir, "documents").select(k.alias("id"), keys.alias("keys"))


@query()
def discovery_dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of a key wins, over all candidates; depends on the order, beyond SQL."""
    return D.first_wins(_candidates(spark, sf_dir)).select("id")


@query()
def discovery_dedupe_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As W8, with the candidates that have most fields filled first."""
    k = F.col("id")
    shown = lambda n: F.when(k % n == 0, k.cast("string"))
    # Every candidate has a site; whether it has a phone, an email, a category, a street and a city is dealt by id.
    found = _candidates(spark, sf_dir).withColumn("completeness", D.completeness(F.lit("site"), *map(shown, (2, 3, 5, 7, 11))))
    return D.first_wins(found, order=[-F.col("completeness")]).select("id", "completeness")


_GRID = "SELECT c_custkey AS id, 30 + (c_custkey % 97) * 0.01 AS lat, -95 + (c_custkey % 89) * 0.01 AS lon FROM customer"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return A.table(spark, sf_dir, "customer").select(k.alias("id"), (30 + (k % 97) * F.lit(0.01)).alias("lat"), (-95 + (k % 89) * F.lit(0.01)).alias("lon"))


@query(f"WITH p AS (SELECT id, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM ({_GRID})) SELECT count(*) AS pairs, sum(a.id + 2 * b.id)::BIGINT AS checksum FROM p a JOIN p b ON a.id < b.id AND abs(a.lat - b.lat) <= 0.015 AND abs(a.lon - b.lon) <= 0.015")
def band_join_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places near one another, by grid cells; the steps of the grid leave no tie at the bound."""
    before = D.earlier_neighbours(_grid(spark, sf_dir), 0.015)
    return before.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.sum(F.col("total") + 2 * F.col("id") * F.col("n")).alias("checksum"))


@query(f"SELECT box, count(*) AS n, min(id) AS first_id FROM ({_GRID}) p JOIN (VALUES (1, 30.005, -95.005, 30.505, -94.505), (2, 30.205, -94.805, 31.505, -94.005), (3, 40.0, -95.0, 41.0, -94.0)) b(box, south, west, north, east) ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY 1")
def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in boxes, by grid cells."""
    boxes = spark.createDataFrame([(1, 30.005, -95.005, 30.505, -94.505), (2, 30.205, -94.805, 31.505, -94.005), (3, 40.0, -95.0, 41.0, -94.0)], "id int, south double, west double, north double, east double")
    return D.boxes_of_points(_grid(spark, sf_dir), boxes).groupBy("box").agg(F.count("*").alias("n"), F.min("point").alias("first_id"))


_BATCHES = """batches AS (SELECT 'f' || (user_id % 17) AS family, 'p' || (user_id % 5) AS place, operation AS category, event_id AS batch, coalesce(quantity, 0) % 20 AS raw, CASE WHEN coalesce(quantity, 0) % 3 = 0 THEN 1 ELSE 0 END AS accepted,
      coalesce(quantity, 0) % 4 AS duplicates, coalesce(quantity, 0) % 7 AS rejected, user_id % 17 = 3 AS required FROM usage_events)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, u = F.coalesce("quantity", F.lit(0)), F.col("user_id")
    return A.usage_events(spark, sf_dir).select(
        F.concat(F.lit("f"), (u % 17).cast("string")).alias("family"), F.concat(F.lit("p"), (u % 5).cast("string")).alias("place"), F.col("operation").alias("category"), F.col("event_id").alias("batch"), (q % 20).alias("raw"),
        F.when(q % 3 == 0, 1).otherwise(0).alias("accepted"), (q % 4).alias("duplicates"), (q % 7).alias("rejected"), (u % 17 == 3).alias("required"),
    )


@query(
    with_(EVENTS, _BATCHES)
    + " SELECT family, place, category, sum(raw)::BIGINT AS raw, sum(accepted)::BIGINT AS accepted, sum(duplicates)::BIGINT AS duplicates, sum(rejected)::BIGINT AS rejected, count(*) AS batches, round(sum(accepted) / count(*), 4) AS yield_per_query FROM batches GROUP BY GROUPING SETS ((family), (place), (category), ())"
)
def yield_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yields by family, place, category and in all."""
    return D.yields(_batches(spark, sf_dir))


@query(
    with_(EVENTS, _BATCHES)
    + """, m AS (SELECT *, max(CASE WHEN accepted > 0 THEN batch END) OVER (PARTITION BY family) AS last_hit FROM batches)
    SELECT family, count(*) FILTER (WHERE last_hit IS NULL OR batch > last_hit) AS streak, bool_or(required) AS required, NOT bool_or(required) AND count(*) FILTER (WHERE last_hit IS NULL OR batch > last_hit) >= 3 AS skip FROM m GROUP BY 1"""
)
def yield_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with three batches in a row without a new company are left unless required."""
    return D.zero_streaks(_batches(spark, sf_dir)).select("family", "streak", "required", "skip")


@query(
    with_(EVENTS, _BATCHES)
    + """, t AS (SELECT family, sum(raw) AS r, sum(accepted) AS a, sum(duplicates) AS d, sum(rejected) AS j, bool_or(required) AS q FROM batches GROUP BY 1),
    p AS (SELECT family, (a * 100 - d * 15 - j * 2 - CASE WHEN r > 0 AND a = 0 THEN r * 3 ELSE 0 END + CASE WHEN q THEN 25 ELSE 0 END)::BIGINT AS priority, a FROM t),
    k AS (SELECT *, row_number() OVER (ORDER BY a DESC, family) AS k FROM p)
    SELECT family, priority, (SELECT string_agg(family || ':' || a, ' | ' ORDER BY a DESC, family) FROM k WHERE k <= 8) AS summary FROM k"""
)
def yield_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of families that have queries, and the eight best in a line."""
    totals = _batches(spark, sf_dir).groupBy("family").agg(*(F.sum(c).alias(c) for c in ("raw", "accepted", "duplicates", "rejected")), F.bool_or("required").alias("required"), F.count("*").alias("issued"))
    worth = D.priority(*(F.col(c) for c in ("raw", "accepted", "duplicates", "rejected", "required", "issued"))).cast("long")
    best = totals.orderBy(F.desc("accepted"), "family").limit(8)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("accepted")).alias("n"), "family")))
    line = best.agg(F.array_join(F.transform(listed, lambda x: F.concat(x["family"], F.lit(":"), (-x["n"]).cast("string"))), " | ").alias("summary"))
    # One row.
    return totals.select("family", worth.alias("priority")).crossJoin(F.broadcast(line))


_OUTCOME = "CASE operation WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'EMPTY' ELSE 'SKIPPED' END"


@query(
    with_(EVENTS)
    + f""", t AS (SELECT user_id, count(*) AS attempted, count(*) FILTER (WHERE o = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE o = 'EMPTY') AS empty, count(*) FILTER (WHERE o = 'FAILED') AS failed, count(*) FILTER (WHERE o = 'SKIPPED') AS skipped
      FROM (SELECT user_id, {_OUTCOME} AS o FROM usage_events WHERE value > 40) GROUP BY 1) SELECT *, CASE WHEN succeeded > 0 THEN CASE WHEN failed > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END WHEN failed = attempted THEN 'FAILED' WHEN skipped = attempted THEN 'SKIPPED' ELSE 'EMPTY' END AS status FROM t"""
)
def provider_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of attempts, and one status for all of a key."""
    op = F.col("operation")
    outcome = F.when(op == "purchase", "SUCCEEDED").when(op == "error", "FAILED").when(op == "view", "EMPTY").otherwise("SKIPPED")
    return D.provider_outcomes(A.usage_events(spark, sf_dir).filter("value > 40").withColumn("outcome", outcome), ["user_id"])


@query(with_(EVENTS) + " SELECT date_trunc('day', created_at)::TIMESTAMP AS day, operation, coalesce(sum(quantity), 0)::BIGINT AS units, count(*) AS events FROM usage_events GROUP BY 1, 2")
def usage_summary_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each operation on each UTC day."""
    return usage.daily(A.usage_events(spark, sf_dir))


@query(with_(EVENTS) + " SELECT event_id, user_id, operation FROM usage_events WHERE operation = 'purchase' AND created_at >= TIMESTAMP '2024-01-10' ORDER BY created_at, event_id LIMIT 25 OFFSET 50")
def usage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a filtered history, oldest first."""
    rows = A.usage_events(spark, sf_dir).filter((F.col("operation") == "purchase") & (F.col("created_at") >= F.lit("2024-01-10").cast("timestamp")))
    return page(rows, [F.asc("created_at"), F.asc("event_id")], 3, 25).select("event_id", "user_id", "operation")


@query(
    with_(EVENTS)
    + """, d AS (SELECT operation, coalesce(sum(quantity), 0)::BIGINT AS units FROM usage_events WHERE date_trunc('day', created_at) = TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT operation, units, l AS "limit", coalesce(units + 3 <= l, true) AS allowed, greatest(0, l - units) AS remaining FROM d LEFT JOIN (VALUES ('purchase', 60), ('signup', 900), ('click', 2500)) v(operation, l) USING (operation)""".replace("greatest(0, l - units)", "CASE WHEN l IS NULL THEN 0 ELSE greatest(0, l - units) END")
)
def usage_quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether three more units are within the day's quota."""
    day = usage.daily(A.usage_events(spark, sf_dir)).filter(F.col("day") == F.lit("2024-01-15").cast("timestamp")).drop("day", "events")
    return usage.quota(day, 3)


@query(
    with_(EVENTS)
    + " SELECT operation, count(*) AS events, round(sum(price * quantity * 1.5::DOUBLE), 4) AS cost, CASE WHEN max(price) IS NULL THEN 'UNKNOWN' ELSE 'ESTIMATED' END AS cost_status FROM usage_events LEFT JOIN (VALUES ('purchase', 0.25::DOUBLE), ('click', 0.5::DOUBLE)) p(operation, price) USING (operation) GROUP BY 1"
)
def usage_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by operation."""
    prices = spark.createDataFrame([("purchase", 0.25), ("click", 0.5)], "operation string, price double")
    return usage.cost(A.usage_events(spark, sf_dir), prices, F.lit(1.5))


@query(with_(EVENTS) + " SELECT user_id, operation, date_trunc('minute', created_at)::TIMESTAMP AS window_start, count(*) AS hits FROM usage_events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def rate_window_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users over a rate in a clock minute."""
    return usage.minute_windows(A.usage_events(spark, sf_dir), 1)


_CELLS = ["=1+2", "@SUM", "-10", "+cmd", "safe", 'ACME, "North"', "", None]
_WANT = ["'=1+2", "'@SUM", "'-10", "'+cmd", "safe", '"ACME, ""North"""', "NOT_FOUND", "NOT_FOUND"]
_q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {_q(w)})' for i, w in enumerate(_WANT))}) v(id, cell)")
def export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that no spreadsheet takes for a formula, quoted for CSV."""
    rows = spark.createDataFrame(list(enumerate(_CELLS)), "id int, value string")
    return rows.select("id", export.csv_cell(export.safe_cell(F.col("value"))).alias("cell"))


@query(
    with_(COMPANIES, SCORES, LATEST_SCORES)
    + """ SELECT concat_ws(',', name, state, coalesce(email, 'NOT_FOUND'), CASE WHEN length(trim(phone)) = 0 THEN phone WHEN phone LIKE '+%' THEN '''' || phone ELSE phone END, coalesce(employee_count::VARCHAR, 'UNKNOWN'), coalesce(employee_range, 'UNKNOWN'),
      coalesce(score::VARCHAR, 'NOT_FOUND'), strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' UTC') AS line FROM companies c LEFT JOIN latest_scores s ON s.company_id = c.id WHERE org_id = 2"""
)
def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads as lines of CSV."""
    scores = leads.latest_scores(A.scores(spark, sf_dir)).select(F.col("company_id").alias("id"), "score")
    found = A.companies(spark, sf_dir).filter("org_id = 2").join(scores, "id", "left")
    return export.lines(found, ["name", "state", "email", "phone", "employee_count", "employee_range", "score", "created_at"])


@query(
    with_(COMPANIES, SCORES, LATEST_SCORES, VERIFICATIONS, LATEST_FIELDS)
    + """, f AS (SELECT company_id, max(CASE WHEN field = 'website' THEN status END) AS site, bool_or(status = 'CONFLICT') AS conflict FROM latest_fields GROUP BY 1),
    c AS (SELECT c.id, CASE WHEN name <> '' THEN 'MATCH' ELSE 'NOT_FOUND' END AS identity, CASE WHEN f.site IN ('VERIFIED', 'SUPPORTED') THEN 'MATCH' WHEN f.site IN ('CONFLICT', 'NEEDS_REVIEW') THEN 'NEEDS_REVIEW' ELSE 'NOT_FOUND' END AS website,
        CASE WHEN state IN ('NATION_1', 'NATION_6', 'NATION_11') THEN 'MATCH' ELSE 'NO_MATCH' END AS location,
        CASE WHEN employee_count IS NOT NULL THEN CASE WHEN employee_count BETWEEN 1 AND 200 THEN 'MATCH' ELSE 'NO_MATCH' END WHEN employee_range = 'unknown' THEN 'NOT_FOUND'
          WHEN split_part(employee_range, '–', 1)::INTEGER >= 1 AND split_part(employee_range, '–', 2)::INTEGER <= 200 THEN 'MATCH' ELSE 'NOT_FOUND' END AS size,
        CASE WHEN coalesce(conflict, false) THEN 'NEEDS_REVIEW' ELSE 'MATCH' END AS conflicts, coalesce(score, 0) AS score FROM companies c LEFT JOIN f ON f.company_id = c.id LEFT JOIN latest_scores s ON s.company_id = c.id WHERE org_id = 1),
    j AS (SELECT id, score, CASE WHEN 'NO_MATCH' IN (identity, website, location, size, conflicts) THEN 'NOT_QUALIFIED' WHEN identity <> 'MATCH' OR website <> 'MATCH' OR location <> 'MATCH' OR size <> 'MATCH' OR conflicts <> 'MATCH' THEN 'NEEDS_REVIEW'
        WHEN score < 20 THEN 'NEEDS_REVIEW' ELSE 'QUALIFIED' END AS status,
      concat_ws(',', CASE WHEN identity = 'NO_MATCH' THEN 'identity' END, CASE WHEN website = 'NO_MATCH' THEN 'website' END, CASE WHEN location = 'NO_MATCH' THEN 'location' END, CASE WHEN size = 'NO_MATCH' THEN 'size' END) AS failed FROM c)
    SELECT id, status, failed FROM j"""
)
def qualify_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 Q3 Q4 Q5 Q6 Q15 Q16 Q17: criteria of each lead, and the verdict that the final gate leaves."""
    return _qualified(spark, sf_dir).select("id", "status", F.array_join(F.transform(F.filter("criteria", lambda c: c["code"] == "NO_MATCH"), lambda c: c["name"]), ",").alias("failed"))


def _qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.companies(spark, sf_dir).filter("org_id = 1").select(F.col("id").alias("company_id"))
    fields = E.latest_fields(A.verifications(spark, sf_dir, own)).groupBy("company_id").agg(F.max(F.when(F.col("field") == "website", F.col("status"))).alias("website_status"), F.bool_or(F.col("status") == "CONFLICT").alias("conflict"))
    scores = leads.latest_scores(A.of_companies(A.scores(spark, sf_dir), own)).select("company_id", "score")
    found = A.companies(spark, sf_dir).filter("org_id = 1").withColumnRenamed("id", "company_id").join(fields, "company_id", "left").join(scores, "company_id", "left").withColumnRenamed("company_id", "id")
    return qualify.qualify(found, search_plan.SearchPlan(states=("NATION_1", "NATION_6", "NATION_11"), size_min=1, size_max=200), min_score=20)


@query(
    "WITH q AS ("
    + ORACLES["qualify_leads"].replace("WITH companies", "WITH companies", 1)
    + ") SELECT count(*) FILTER (WHERE status = 'QUALIFIED') AS qualified, count(*) FILTER (WHERE status = 'NOT_QUALIFIED') AS not_qualified, count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS needs_review, greatest(0, 50 - count(*) FILTER (WHERE status = 'QUALIFIED')) AS shortfall FROM q"
)
def qualify_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts counted, and what is missing to the number asked for."""
    q = F.count_if(F.col("status") == "QUALIFIED")
    return _qualified(spark, sf_dir).agg(q.alias("qualified"), F.count_if(F.col("status") == "NOT_QUALIFIED").alias("not_qualified"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review"), F.greatest(F.lit(0), 50 - q).alias("shortfall"))


@query(
    """SELECT id, kind, k, query FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, s) AS k FROM (SELECT id, kind, p, s, phrase || ' ' || place AS query FROM (VALUES (1, 'software', 'Texas'), (2, 'real estate', 'Utah')) v(id, kind, place),
      LATERAL (SELECT unnest([kind || ' companies', kind || ' firms']) AS phrase, unnest([0, 1]) AS p), LATERAL (SELECT 0 AS s))) WHERE k <= 2"""
)
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search phrases times places, within a budget."""
    asked = spark.createDataFrame([(1, "software", "Texas"), (2, "real estate", "Utah")], "id int, kind string, place string")
    spread = asked.select("id", "kind", "place", F.posexplode(F.array(F.concat("kind", F.lit(" companies")), F.concat("kind", F.lit(" firms")))).alias("p", "phrase"))
    w = Window.partitionBy("id").orderBy("p")
    return spread.withColumn("k", F.row_number().over(w).cast("long")).filter("k <= 2").select("id", "kind", "k", F.concat_ws(" ", "phrase", "place").alias("query"))


@query()
def prompt_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X34, and the count, size and place of P1: what users' prompts ask for; free text, so rows only."""
    prompts = A.table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return search_plan.parse_prompts(prompts, "text").drop("text")
