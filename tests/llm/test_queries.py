import pytest

from leadloom.llm import queries
from tests.oracle import connection, same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_toxic_held_out_rows_are_found(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = queries.QUERIES["op6_toxicity"](spark, sf_dir).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    assert sum(r["predicted"] == r["toxic"] for r in judged) >= 0.9 * len(judged)


def test_toxic_held_out_rows_are_told_apart(spark):
    """Recall and precision on a table with enough toxic rows that were not learnt from."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = queries.QUERIES["op6_toxicity"](spark, sf_dir).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    toxic = [r for r in judged if r["toxic"] == 1]
    hits = sum(r["predicted"] for r in toxic)
    assert len(toxic) >= 5 and hits >= 0.6 * len(toxic) and hits >= 0.6 * max(1, sum(r["predicted"] for r in judged))
