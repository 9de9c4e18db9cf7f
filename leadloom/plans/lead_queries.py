"""Queries over leads: listing, facets, sizes, candidates, hydration, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import leads
from leadloom.operators.leads import LeadFilter
from leadloom.operators.relational import append_new, intersect_ids, latest_by, page, remap, upsert
from leadloom.plans.entities_sql import COMPANIES, LATEST_FIELDS, LATEST_SCORES, SCORES, SOURCES, VERIFICATIONS, with_
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
    with_(COMPANIES, SCORES, LATEST_SCORES)
    + """, found AS (SELECT c.*, s.score FROM companies c JOIN latest_scores s ON s.company_id = c.id WHERE org_id = 1 AND s.score BETWEEN 10 AND 100)
    SELECT id, name, state, score, (SELECT count(*) FROM found) AS total, ceil((SELECT count(*) FROM found) / 25.0)::BIGINT AS total_pages
    FROM found ORDER BY score DESC, id LIMIT 25"""
)
def leads_page_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a tenant's leads by latest score."""
    found = leads.listing(A.companies(spark, sf_dir), A.scores(spark, sf_dir), LeadFilter(1, min_score=10))
    return found.select("id", "name", "state", "score", "total", "total_pages")


@query(
    with_(COMPANIES, SCORES, VERIFICATIONS)
    + """ SELECT id, name, state FROM companies WHERE org_id = 2 AND (name ILIKE '%customer#%' OR website ILIKE '%customer#%') AND (state ILIKE 'nation_12')
      AND created_at >= TIMESTAMP '2000-01-02' AND created_at <= TIMESTAMP '2003-01-01' AND email IS NOT NULL AND length(trim(email)) > 0
      AND id IN (SELECT company_id FROM verifications WHERE status = 'VERIFIED') AND id IN (SELECT company_id FROM verifications WHERE status = 'CONFLICT')"""
)
def leads_facets_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row filters, and two facets of any verification ever made."""
    found = A.companies(spark, sf_dir).filter(leads.conditions(LeadFilter(2, search="customer#", state="nation_12", created_from="2000-01-02", created_to="2003-01-01", has_email=True)))
    checked = A.verifications(spark, sf_dir)
    facets = [checked.filter(F.col("status") == s).select("company_id") for s in ("VERIFIED", "CONFLICT")]
    return intersect_ids(found, "id", facets).select("id", "name", "state")


@query(
    with_(SCORES, LATEST_SCORES)
    + """ SELECT (SELECT count(DISTINCT company_id) FROM scores WHERE score >= 60) AS any_history, (SELECT count(*) FROM latest_scores WHERE score >= 60) AS latest"""
)
def leads_any_history_vs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facet over all history finds more than one over the latest rows."""
    scores = A.scores(spark, sf_dir)
    ever = scores.filter("score >= 60").agg(F.countDistinct("company_id").alias("any_history"))
    return ever.crossJoin(leads.latest_scores(scores).filter("score >= 60").agg(F.count("*").alias("latest")))


_SPAN = "regexp_extract(replace(employee_range, '–', '-'), '^([0-9]+)-([0-9]+)$', {})"
_STATUS = f"""CASE WHEN employee_count IS NOT NULL THEN CASE WHEN employee_count BETWEEN {{0}} AND {{1}} THEN 'MATCHED' ELSE 'OUTSIDE_RANGE' END
      WHEN TRY_CAST({_SPAN.format(1)} AS INTEGER) >= {{0}} AND TRY_CAST({_SPAN.format(2)} AS INTEGER) <= {{1}} THEN 'MATCHED'
      WHEN TRY_CAST({_SPAN.format(2)} AS INTEGER) < {{0}} OR TRY_CAST({_SPAN.format(1)} AS INTEGER) > {{1}} THEN 'OUTSIDE_RANGE' ELSE 'UNKNOWN' END"""


@query(with_(COMPANIES) + f" SELECT {_STATUS.format(10, 60)} AS size_status, count(*) AS n, min(id) AS first_id FROM companies WHERE org_id = 0 GROUP BY 1")
def size_filter_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """companies by their size against given bounds."""
    found = A.companies(spark, sf_dir).filter("org_id = 0").withColumn("size_status", leads.size_status(10, 60))
    return found.groupBy("size_status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    with_(COMPANIES, SOURCES)
    + f""", plans AS (SELECT DISTINCT execution_id, CASE WHEN substr(execution_id, 6, 2) IN ('01', '02', '03') THEN (CASE WHEN substr(execution_id, 6, 2) = '01' THEN 20 END) END AS low,
      CASE WHEN substr(execution_id, 6, 2) = '02' THEN 45 END AS high, substr(execution_id, 6, 2) IN ('01', '02', '03') AS asked FROM source_records)
    SELECT id, name FROM companies WHERE org_id = 3 AND EXISTS (SELECT 1 FROM source_records r JOIN plans p USING (execution_id) WHERE r.company_id = companies.id AND p.asked
      AND {_STATUS.format("coalesce(p.low, -2147483648)", "coalesce(p.high, 2147483647)")} = 'MATCHED')"""
)
def size_filter_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that match the size asked for by a plan that found them; plans are JSON."""
    records = A.source_records(spark, sf_dir)
    month = F.substring("execution_id", 6, 2)
    plan = F.when(month == "01", '{"companySize":{"min":20}}').when(month == "02", '{"companySize":{"max":45}}').when(month == "03", '{"companySize":null}').otherwise("{}")
    plans = records.select("execution_id").distinct().withColumn("plan", plan)
    # A key that is there with a null value counts as asked.
    asked = plans.filter(F.array_contains(F.json_object_keys("plan"), "companySize"))
    bounds = [F.get_json_object("plan", f"$.companySize.{x}").cast("int") for x in ("min", "max")]
    asked = asked.select("execution_id", F.coalesce(bounds[0], F.lit(leads.LEAST)).alias("low"), F.coalesce(bounds[1], F.lit(leads.MOST)).alias("high"))
    # Distinct bounds per company: few rows before the comparison.
    wanted = records.join(asked, "execution_id").select("company_id", "low", "high").distinct()
    companies = A.companies(spark, sf_dir).filter("org_id = 3")
    a, b = leads.size_span("employee_range")
    count, low, high = F.col("employee_count"), F.col("low"), F.col("high")
    matched = F.when(count.isNotNull(), count.between(low, high)).otherwise((a >= low) & (b <= high) & (a <= b))
    return companies.join(wanted, (F.col("id") == F.col("company_id")) & matched, "left_semi").select("id", "name")


@query(with_(COMPANIES, VERIFICATIONS, LATEST_FIELDS) + " SELECT id, name FROM companies WHERE org_id = 4 AND EXISTS (SELECT 1 FROM latest_fields v WHERE v.company_id = companies.id AND v.field = 'companySize' AND v.status = 'CONFLICT')")
def open_conflict_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies whose size is in conflict now."""
    latest = latest_by(A.verifications(spark, sf_dir).filter("field = 'companySize'"), ["company_id", "field"], ["checked_at", "id", "status"])
    open_ = latest.filter("status = 'CONFLICT'").select(F.col("company_id").alias("id"))
    return A.companies(spark, sf_dir).filter("org_id = 4").join(open_, "id", "left_semi").select("id", "name")


@query("SELECT event_id, event_type FROM events WHERE props ILIKE '%\"k\": 7%'")
def json_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a search in the text of a JSON column."""
    return A.table(spark, sf_dir, "events").filter(F.col("props").ilike('%"k": 7%')).select("event_id", "event_type")


@query(
    with_(COMPANIES, SOURCES)
    + " SELECT r.external_id, c.name, c.state, r.provider FROM source_records r JOIN companies c ON c.id = r.company_id WHERE r.execution_id = '1996-03' AND c.org_id = 1 ORDER BY r.external_id LIMIT 20 OFFSET 20"
)
def candidates_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of an execution's candidates with their company; candidates_with_location adds the location."""
    records = A.source_records(spark, sf_dir).filter("execution_id = '1996-03'")
    companies = A.companies(spark, sf_dir).filter("org_id = 1").select(F.col("id").alias("company_id"), "name", "state")
    return page(records.join(companies, "company_id"), [F.asc("external_id")], 2, 20).select("external_id", "name", "state", "provider")


@query(
    with_(COMPANIES, SCORES, LATEST_SCORES, VERIFICATIONS, LATEST_FIELDS, SOURCES)
    + """ SELECT c.id, c.name, s.score, coalesce(v.n_fields, 0) AS n_fields, coalesce(v.n_verified, 0) AS n_verified, coalesce(r.n_sources, 0) AS n_sources, r.first_source
    FROM companies c LEFT JOIN latest_scores s ON s.company_id = c.id
    LEFT JOIN (SELECT company_id, count(*) AS n_fields, count(*) FILTER (WHERE status = 'VERIFIED') AS n_verified FROM latest_fields GROUP BY 1) v ON v.company_id = c.id
    LEFT JOIN (SELECT company_id, count(*) AS n_sources, arg_min(external_id, (retrieved_at, external_id)) AS first_source FROM source_records GROUP BY 1) r ON r.company_id = c.id WHERE org_id = 0"""
)
def hydrate_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with what their child tables hold (3 of 11); children are cut to the tenant's companies, then aggregated, then joined."""
    own = A.companies(spark, sf_dir).filter("org_id = 0").select(F.col("id").alias("company_id"))
    scores = leads.latest_scores(A.of_companies(A.scores(spark, sf_dir), own)).select("company_id", "score")
    fields = latest_by(A.verifications(spark, sf_dir, own), ["company_id", "field"], ["checked_at", "id", "status"]).groupBy("company_id").agg(F.count("*").alias("n_fields"), F.count_if(F.col("status") == "VERIFIED").alias("n_verified"))
    records = A.of_companies(A.source_records(spark, sf_dir), own).groupBy("company_id").agg(F.count("*").alias("n_sources"), F.min_by("external_id", F.struct("retrieved_at", "external_id")).alias("first_source"))
    out = A.companies(spark, sf_dir).filter("org_id = 0").withColumnRenamed("id", "company_id")
    for child in (scores, fields, records):
        out = out.join(child, "company_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("company_id").alias("id"), "name", "score", zero("n_fields"), zero("n_verified"), zero("n_sources"), "first_source")


@query(
    with_(SOURCES, SCORES, LATEST_SCORES)
    + """ SELECT execution_id, count(*) AS n_records, count(DISTINCT r.company_id) AS n_companies, count(*) FILTER (WHERE s.score >= 60) AS n_qualified
    FROM source_records r LEFT JOIN latest_scores s ON s.company_id = r.company_id GROUP BY 1"""
)
def execution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each execution."""
    latest = leads.latest_scores(A.scores(spark, sf_dir)).select("company_id", "score")
    joined = A.source_records(spark, sf_dir).join(latest, "company_id", "left")
    return joined.groupBy("execution_id").agg(F.count("*").alias("n_records"), F.countDistinct("company_id").alias("n_companies"), F.count_if(F.col("score") >= 60).alias("n_qualified"))


@query(
    with_(COMPANIES, SOURCES, VERIFICATIONS, SCORES)
    + """, found AS (SELECT DISTINCT company_id FROM source_records WHERE execution_id = '1995-05')
    SELECT (SELECT count(*) FROM found) AS discovered, (SELECT count(DISTINCT v.company_id) FROM verifications v JOIN found USING (company_id) WHERE status = 'VERIFIED') AS verified,
      (SELECT count(*) FROM verifications v JOIN found USING (company_id)) AS facts, (SELECT max(checked_at) FROM verifications v JOIN found USING (company_id)) AS facts_version,
      (SELECT count(DISTINCT s.company_id) FROM scores s JOIN found USING (company_id)) AS scored, NULL::BIGINT AS exported"""
)
def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an execution; the counter of a stage that has not begun is masked."""
    found = A.source_records(spark, sf_dir).filter("execution_id = '1995-05'").select("company_id").distinct()
    checked = A.verifications(spark, sf_dir).join(found, "company_id", "left_semi")
    facts = checked.agg(F.countDistinct(F.when(F.col("status") == "VERIFIED", F.col("company_id"))).alias("verified"), F.count("*").alias("facts"), F.max("checked_at").alias("facts_version"))
    scored = A.scores(spark, sf_dir).join(found, "company_id", "left_semi").agg(F.countDistinct("company_id").alias("scored"))
    states = {"export": "PENDING"}
    exported = F.when(F.lit(states["export"]) != "PENDING", F.lit(0)).cast("long").alias("exported")
    # Each side is one row.
    return found.agg(F.count("*").alias("discovered")).crossJoin(facts).crossJoin(scored).select("*", exported)


@query(
    with_(SOURCES)
    + """ SELECT company_id, provider, external_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id, provider ORDER BY (execution_id >= '1997-01'), external_id) AS k,
      execution_id >= '1997-01' AS fresh, bool_or(execution_id < '1997-01') OVER (PARTITION BY company_id, provider) AS known FROM source_records)
    WHERE (NOT fresh AND external_id = first_old) OR (fresh AND NOT known AND k = 1)""".replace("external_id = first_old", "k = 1")
)
def append_new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are added unless their key is there; of equal new keys the first goes in."""
    records = A.source_records(spark, sf_dir)
    old = records.filter("execution_id < '1997-01'").groupBy("company_id", "provider").agg(F.min("external_id").alias("external_id"))
    new = records.filter("execution_id >= '1997-01'").select("company_id", "provider", "external_id")
    return append_new(old, new, ["company_id", "provider"], ["external_id"])


@query(with_(SCORES) + " SELECT company_id, score, id FROM scores QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY (calculated_at >= TIMESTAMP '1997-01-01') DESC, calculated_at DESC, id DESC) = 1")
def upsert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: an incoming score takes the place of the stored one."""
    scores = A.scores(spark, sf_dir)
    old = latest_by(scores.filter("calculated_at < '1997-01-01'"), ["company_id"], ["calculated_at", "id"])
    new = scores.filter("calculated_at >= '1997-01-01'")
    return upsert(old, new.select(old.columns), ["company_id"], ["calculated_at", "id"]).select("company_id", "score", "id")


@query(with_(SCORES) + " SELECT CASE WHEN company_id % 10 = 3 THEN company_id - 1 ELSE company_id END AS company_id, count(*) AS n FROM scores GROUP BY 1")
def remap_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a merge, children point to the master."""
    merged = A.table(spark, sf_dir, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("loser"), (F.col("c_custkey") - 1).alias("master"))
    return remap(A.scores(spark, sf_dir), "company_id", merged).groupBy("company_id").agg(F.count("*").alias("n"))


@query(
    with_(SOURCES)
    + """, plans AS (SELECT company_id, execution_id FROM source_records QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY retrieved_at DESC, external_id DESC) = 1)
    SELECT execution_id, count(*) AS n FROM plans GROUP BY 1"""
)
def newest_plan_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest execution of each company."""
    newest = A.source_records(spark, sf_dir).groupBy("company_id").agg(F.max_by("execution_id", F.struct("retrieved_at", "external_id")).alias("execution_id"))
    return newest.groupBy("execution_id").agg(F.count("*").alias("n"))


@query(
    with_(COMPANIES)
    + """ SELECT category, sum((email IS NOT NULL)::INTEGER + (length(trim(phone)) > 0)::INTEGER + (employee_count IS NOT NULL OR (employee_range IS NOT NULL AND employee_range <> 'unknown'))::INTEGER + 2)::BIGINT AS filled,
      count(*) FILTER (WHERE email IS NULL) AS needs_email, count(*) FILTER (WHERE length(trim(phone)) = 0) AS needs_phone, count(*) FILTER (WHERE employee_count IS NULL AND employee_range = 'unknown') AS needs_size FROM companies GROUP BY 1"""
)
def completeness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled fields, and what is still needed."""
    size = F.col("employee_count").isNotNull() | (F.col("employee_range").isNotNull() & (F.col("employee_range") != "unknown"))
    there = {"name": F.lit(True), "website": leads.present("website"), "email": leads.present("email"), "phone": leads.present("phone"), "size": size}
    filled = sum((F.when(c, 1).otherwise(0) for c in there.values()), F.lit(0))
    needs = [F.count_if(~there[x]).alias(f"needs_{x}") for x in ("email", "phone", "size")]
    return A.companies(spark, sf_dir).groupBy("category").agg(F.sum(filled).cast("long").alias("filled"), *needs)


