"""The driver's tables read as lead-research entities.

Each function is a projection of one table, or of a table and its dimension, so that filters and
column choices reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The field that a line number stands for.
FIELDS = ("companyName", "website", "state", "email", "phone", "title", "companySize")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies of the organisation that is their region."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    low = (key % 40).cast("int")
    return joined.select(
        key.alias("id"),
        F.col("n_regionkey").cast("long").alias("org_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("https://www.Co"), (key % 400).cast("string"), F.lit(".example/")).alias("website"),
        F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("category"),
        F.when(balance > 0, F.concat(F.lit("info@co"), (key % 400).cast("string"), F.lit(".example"))).alias("email"),
        F.when(balance > 3000, F.concat(F.lit("+1 (555) 01"), F.lpad((key % 90).cast("string"), 5, "0"))).otherwise("  ").alias("phone"),
        F.when(key % 3 == 0, (key % 500).cast("int")).alias("employee_count"),
        F.when(key % 3 == 1, F.concat((low + 1).cast("string"), F.lit("–"), (low + 40).cast("string"))).when(key % 3 == 2, F.lit("unknown")).alias("employee_range"),
        F.timestamp_seconds(F.lit(946684800) + key * 3600).alias("created_at"),
        balance.alias("balance"),
    )


def of_companies(rows: DataFrame, companies: DataFrame | None) -> DataFrame:
    """Of rows with a company_id those of `companies` (company_id), or all."""
    return rows if companies is None else rows.join(companies.select("company_id"), "company_id", "left_semi")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the history of lead scores."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000)).cast("int").alias("score"), F.col("o_orderdate").alias("calculated_at")
    )


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as source records: one execution for each month."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("external_id"), F.col("o_custkey").alias("company_id"), F.date_format("o_orderdate", "yyyy-MM").alias("execution_id"), F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("retrieved_at")
    )


def _lines(spark: SparkSession, sf_dir: str, companies: DataFrame | None = None) -> DataFrame:
    # Orders are few beside their lines: the wanted ones are picked first.
    orders = of_companies(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("company_id")), companies)
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _field() -> F.Column:
    return F.get(F.array(*map(F.lit, FIELDS)), ((F.col("l_linenumber") - 1) % len(FIELDS)).cast("int"))


def verifications(spark: SparkSession, sf_dir: str, companies: DataFrame | None = None) -> DataFrame:
    """Line items as field verifications, of all companies or of some."""
    status = F.when(F.col("l_returnflag") == "A", "VERIFIED").when(F.col("l_returnflag") == "R", "CONFLICT").when(F.col("l_quantity") > 40, "NEEDS_REVIEW").when(F.col("l_quantity") > 10, "SUPPORTED").otherwise("NOT_FOUND")
    return _lines(spark, sf_dir, companies).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "company_id", _field().alias("field"), status.alias("status"), F.col("l_shipdate").alias("checked_at"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence: a claimed value of a field, from a supplier's site or, without one, from a provider."""
    url = F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("https://www.s"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".example.co.uk/page")))
    return _lines(spark, sf_dir).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "company_id", _field().alias("field"), F.concat(F.lit(" Value "), (F.col("l_partkey") % 2).cast("string")).alias("value"),
        url.alias("source_url"), F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string")).alias("provider"), F.col("l_returnflag").alias("evidence_type"), F.col("l_shipdate").alias("retrieved_at"),
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the usage log: the operation is the event type, units come from the properties."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.col("user_id"), F.col("event_type").alias("operation"), F.col("value"), F.get_json_object("props", "$.k").cast("int").alias("quantity"), "props")
