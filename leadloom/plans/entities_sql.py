"""The entities of sources.adapters as SQL, for the queries' counterparts."""

COMPANIES = """companies AS (
  SELECT c_custkey AS id, n_regionkey::BIGINT AS org_id, c_name AS name, 'https://www.Co' || (c_custkey % 400) || '.example/' AS website,
    n_name AS state, c_mktsegment AS category,
    CASE WHEN c_acctbal > 0 THEN 'info@co' || (c_custkey % 400) || '.example' END AS email,
    CASE WHEN c_acctbal > 3000 THEN '+1 (555) 01' || lpad((c_custkey % 90)::VARCHAR, 5, '0') ELSE '  ' END AS phone,
    CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 500)::INTEGER END AS employee_count,
    CASE WHEN c_custkey % 3 = 1 THEN (c_custkey % 40 + 1) || '–' || (c_custkey % 40 + 40) WHEN c_custkey % 3 = 2 THEN 'unknown' END AS employee_range,
    make_timestamp((946684800 + c_custkey * 3600) * 1000000) AS created_at, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

SCORES = """scores AS (
  SELECT o_orderkey AS id, o_custkey AS company_id, least(100, floor(o_totalprice / 5000))::INTEGER AS score, o_orderdate AS calculated_at FROM orders)"""

LATEST_SCORES = """latest_scores AS (
  SELECT company_id, score, calculated_at FROM scores QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY calculated_at DESC, id DESC) = 1)"""

SOURCES = """source_records AS (
  SELECT o_orderkey AS external_id, o_custkey AS company_id, strftime(o_orderdate, '%Y-%m') AS execution_id, o_orderpriority AS provider, o_orderdate AS retrieved_at FROM orders)"""

_FIELD = "['companyName', 'website', 'state', 'email', 'phone', 'title', 'companySize'][(l_linenumber - 1) % 7 + 1]"

VERIFICATIONS = f"""verifications AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS company_id, {_FIELD} AS field,
    CASE WHEN l_returnflag = 'A' THEN 'VERIFIED' WHEN l_returnflag = 'R' THEN 'CONFLICT' WHEN l_quantity > 40 THEN 'NEEDS_REVIEW'
      WHEN l_quantity > 10 THEN 'SUPPORTED' ELSE 'NOT_FOUND' END AS status, l_shipdate AS checked_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

LATEST_FIELDS = """latest_fields AS (
  SELECT * FROM verifications QUALIFY row_number() OVER (PARTITION BY company_id, field ORDER BY checked_at DESC, id DESC, status DESC) = 1)"""

EVIDENCE = f"""evidence AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS company_id, {_FIELD} AS field, ' Value ' || (l_partkey % 2) AS value,
    CASE WHEN l_suppkey % 5 > 0 THEN 'https://www.s' || (l_suppkey % 7) || '.example.co.uk/page' END AS source_url,
    'p' || (l_suppkey % 3) AS provider, l_returnflag AS evidence_type, l_shipdate AS retrieved_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

EVENTS = """usage_events AS (
  SELECT event_id, ts AS created_at, user_id, event_type AS operation, value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS quantity, props FROM events)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts)
