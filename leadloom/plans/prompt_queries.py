"""Prompts, plans and drafts of plans as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import gazetteer
from leadloom.operators import drafts, place_scan, prompts
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


#: Names of countries, states and cities, one that nobody knows among them.
PLACES = ("Germany", "TX", "Dubai", "Bavaria", "the United States", "Toronto", "New York", "Lyon, France")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as prompts, a row each: (id, n, kind, place, low, high, role, prompt). Their nations stand for places."""
    customer, key = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    place = F.get(F.array(*map(F.lit, PLACES)), F.col("c_nationkey") % len(PLACES))
    role = F.get(F.array(*map(F.lit, ("CEO", "Founder", "President", "Owner"))), (key % 4).cast("int"))
    parts = customer.select(
        key.alias("id"), (key % 300 + 1).cast("int").alias("n"), F.lower("c_mktsegment").alias("kind"), place.alias("place"), (key % 20 + 1).cast("int").alias("low"), (key % 20 + 50).cast("int").alias("high"), role.alias("role"),
    )
    return parts.withColumn("prompt", F.format_string("Find %d %s companies in %s with %d-%d employees, %s and LinkedIn", "n", "kind", "place", "low", "high", "role"))


#: The same in SQL, with what the reading of place names gives.
ASKED = """names(i, place, country, state, city) AS (
  VALUES (0, 'Germany', 'Germany', NULL, NULL), (1, 'TX', 'US', 'Texas', NULL), (2, 'Dubai', 'United Arab Emirates', NULL, 'Dubai'), (3, 'Bavaria', '', NULL, 'Bavaria'), (4, 'the United States', 'US', NULL, NULL), (5, 'Toronto', 'Canada', 'Ontario', 'Toronto'),
    (6, 'New York', 'US', 'New York', NULL), (7, 'Lyon, France', 'France', NULL, 'Lyon')), asked AS (
  SELECT c_custkey AS id, (c_custkey % 300 + 1)::INT AS n, lower(c_mktsegment) AS kind, names.*, (c_custkey % 20 + 1)::INT AS low, (c_custkey % 20 + 50)::INT AS high, (['CEO', 'Founder', 'President', 'Owner'])[c_custkey % 4 + 1] AS role
  FROM customer JOIN names ON i = c_nationkey % 8), prompts AS (
  SELECT *, 'Find ' || n || ' ' || kind || ' companies in ' || place || ' with ' || low || '-' || high || ' employees, ' || role || ' and LinkedIn' AS prompt FROM asked)"""


@query(
    f"""WITH {ASKED} SELECT id, 'COMPANIES' AS target_type, kind AS industry, country, state, city, low AS size_min, high AS size_max, n AS requested_count, n AS max_results,
      'exact' AS count_intent, role AS roles, 'companyLinkedin' AS required_fields, 'linkedin' AS social_platforms, 'find ' || n || ' ' || kind || ' in ' || concat_ws(', ', city, state, nullif(country, '')) || ' with ' || low || '-' || high || ' employees' AS search_intent,
      CASE WHEN country = '' THEN place || ': location could not be confidently resolved to a country or administrative area' ELSE '' END AS unresolved FROM prompts"""
)
def prompt_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' prompts read as plans, all rules of the cascade."""
    plan, joined = F.col("plan"), lambda name: F.array_join(F.col("plan")[name], ",").alias(name)
    place = F.get(plan["locations"], F.lit(0))
    unresolved = F.array_join(F.transform(plan["unresolved"], lambda u: F.concat_ws(": ", u["text"], u["reason"])), ";")
    return prompts.parse(_asked(spark, sf_dir)).select(
        "id", plan["target_type"].alias("target_type"), joined("industry"), *(place[x].alias(x) for x in ("country", "state", "city")), plan["company_size"]["min"].alias("size_min"), plan["company_size"]["max"].alias("size_max"),
        *(plan[x].alias(x) for x in ("requested_count", "max_results", "count_intent")), joined("roles"), joined("required_fields"), joined("social_platforms"), plan["search_intent"].alias("search_intent"), unresolved.alias("unresolved"),
    )


@query()
def conversation_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the users of all conversations ask for; free text, so rows only."""
    asked = A.table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    plan = F.col("plan")
    return prompts.parse(asked, "text").select("conv_id", "turn", *(plan[x].alias(x) for x in ("industry", "lead_types", "locations", "roles", "required_fields", "requested_count", "search_intent", "unresolved")))


def _drafted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts with drafts: of ten that follow each other two stand, and eight each have a fault of their own."""
    key, quote = F.col("id") % 10, F.col("prompt")
    evidence = lambda field, value: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), quote.alias("quote"))
    text = lambda value: value.cast("string")
    none, no = F.lit(None).cast("string"), F.lit(False)
    place = F.struct(F.col("place").alias("rawText"), F.when(key == 7, "Atlantis").alias("country"), none.alias("state"), none.alias("city"), none.alias("region"), none.alias("postalCode"))
    size = F.struct(F.when(key == 4, F.col("low") + 1).otherwise(F.col("low")).alias("min"), F.col("high").alias("max"), F.lit(None).cast("int").alias("exact"), none.alias("qualitative"), F.format_string("%d-%d employees", "low", "high").alias("sourceText"))
    empty = F.array().cast("array<string>")
    draft = {
        "requestedCount": F.when(key == 1, F.col("n") + 1000).otherwise(F.col("n")), "countIntent": F.lit("exact"), "targetType": F.lit("COMPANIES"), "industry": F.array(F.when(key == 2, "construction").otherwise(F.col("kind"))), "leadTypes": empty,
        "locations": F.array(place), "employeeSize": size, "decisionMakerRoles": F.when(key == 5, empty).otherwise(F.array(F.col("role"))), "requiredFields": F.array(F.lit("companyLinkedin")), "preferredFields": empty, "companyFields": empty, "personFields": empty,
        "socialPlatforms": F.array(F.lit("linkedin")), "emailRequirement": F.struct((key == 8).alias("requested"), no.alias("required"), no.alias("verified")), "websiteRequirement": F.struct(no.alias("requested"), no.alias("required")),
        "verificationRequirement": F.struct(no.alias("requested"), no.alias("required"), empty.alias("fields")), "minimumScore": F.lit(None).cast("int"), "unresolvedRequirements": F.array().cast("array<struct<text string, reason string, sourceText string>>"),
        "evidenceQuotes": F.array(evidence("fields", F.lit("companyLinkedin")), evidence("socialPlatforms", F.lit("linkedin")), evidence("requestedCount", text(F.col("n")))), "guessedRadius": F.when(key == 3, F.lit(25)),
    }
    written = F.to_json(F.struct(*(v.alias(k) for k, v in draft.items())))
    return _asked(spark, sf_dir).withColumn("draft", F.when(key == 6, F.substring(written, 1, 60)).otherwise(written))


#: A place that is only another name of what the prompt's plan has needs a quote, and these drafts give none.
_FAULT = """CASE WHEN id % 10 = 6 THEN 'not an object' WHEN id % 10 = 3 THEN 'unknown members' WHEN id % 10 = 1 THEN 'ungrounded count: ' || (n + 1000) WHEN id % 10 = 4 THEN 'invented size bound: ' || (low + 1)
      WHEN id % 10 = 2 THEN 'ungrounded industry: construction' WHEN id % 10 = 7 OR place IN ('TX', 'the United States') THEN 'unsupported location: ' || place WHEN id % 10 = 8 THEN 'invented email requirement' WHEN id % 10 = 5 THEN 'omitted role' END"""


@query(f"WITH {ASKED} SELECT id, {_FAULT} AS error, CASE WHEN {_FAULT} IS NULL THEN 'ai' ELSE 'deterministic_fallback' END AS method, kind AS industry, role AS roles, n AS requested_count, low AS size_min, 'companyLinkedin' AS required_fields FROM prompts")
def draft_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts held against their prompts, and the plan that counts in the end."""
    final = F.col("final")
    return drafts.decide(_drafted(spark, sf_dir)).select(
        "id", "error", "method", F.array_join(final["industry"], ",").alias("industry"), F.array_join(final["roles"], ",").alias("roles"), final["requested_count"].alias("requested_count"), final["company_size"]["min"].alias("size_min"),
        F.array_join(final["required_fields"], ",").alias("required_fields"),
    )


@query(
    f"""WITH {ASKED}, l AS (
      SELECT id, prompt, unnest([{{'field': 'requestedCount', 'value': n::VARCHAR, 'at': 6}}, {{'field': 'industry', 'value': kind, 'at': 7 + length(n::VARCHAR)}}, {{'field': 'locations', 'value': place, 'at': instr(prompt, ' in ' || place) + 4}},
        {{'field': 'employeeSize.min', 'value': low::VARCHAR, 'at': instr(prompt, ' with ' || low || '-') + 6}}, {{'field': 'employeeSize.max', 'value': high::VARCHAR, 'at': instr(prompt, '-' || high || ' employees') + 1}},
        {{'field': 'decisionMakerRoles', 'value': role, 'at': instr(prompt, ', ' || role) + 2}}, {{'field': 'socialPlatforms', 'value': 'linkedin', 'at': instr(prompt, 'LinkedIn')}}]) AS x FROM prompts WHERE id % 10 IN (0, 9) AND place NOT IN ('TX', 'the United States'))
    SELECT id, x.field AS field, x.value AS value, x.at - 1 AS begins, x.at - 1 + length(x.value) AS ends FROM l WHERE x.field NOT IN ('requestedCount', 'employeeSize.min', 'employeeSize.max')"""
)
def draft_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the words of drafts that stand are in their prompts; bare numbers, which may stand in several places, and fields, which only a quote names, left out."""
    leaf = F.col("leaf")
    # Nothing of what the explosion yields is pushed below it, where it would be worked out anew for every use.
    judged = drafts.judge(_drafted(spark, sf_dir)).select("id", F.explode_outer(F.when(F.col("method") == "ai", F.col("leaves"))).alias("leaf"))
    return judged.filter(leaf["field"].isin("industry", "locations", "decisionMakerRoles", "socialPlatforms")).select("id", leaf["field"].alias("field"), leaf["value"].alias("value"), leaf["from"].alias("begins"), leaf["to"].alias("ends"))


def _gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(gazetteer.entries(), "name string, country string, state string, city string")


@query()
def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place that documents and conversations name, with what is known of it; free text, so rows only."""
    talk = A.table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.lit("conversation"), "conv_id", "turn").alias("doc_id"), "text")
    texts = A.table(spark, sf_dir, "documents").select(F.concat_ws(":", F.lit("document"), "doc_id").alias("doc_id"), "text").unionByName(talk)
    names = _gazetteer(spark)
    return place_scan.mentions(texts, names).join(F.broadcast(names), "name").select("doc_id", "name", "begins", "ends", "country", "state", "city")


@query(
    f"""WITH {ASKED}, n(i, name) AS (VALUES (0, 'germany'), (2, 'dubai'), (4, 'united states'), (5, 'toronto'), (6, 'new york'), (7, 'france'))
    SELECT id, name, instr(lower(prompt), name)::INT - 1 AS begins, instr(lower(prompt), name)::INT - 1 + length(name)::INT AS ends FROM prompts JOIN n ON n.i = prompts.i"""
)
def prompt_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places that customers' prompts name, by one scan for all names; codes of two letters are words too and not looked for."""
    return place_scan.mentions(_asked(spark, sf_dir), _gazetteer(spark), "id", "prompt")
