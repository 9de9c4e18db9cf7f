"""Pairs and groups against one pass in order."""

import random

import pytest

from leadloom.operators.duplicate_groups import assign

SCHEMA = "rank long, record_a long, record_b long, master long, status string, match_type string, confidence double"


def in_order(rows, pairs, groups):
    """One decision after another. `groups`: canonical records in the order of their founding."""
    pairs, groups, new = set(pairs), list(groups), {}
    founded = []
    for _, x, y, master, status, kind, confidence in sorted(rows):
        if kind == "NO_MATCH" or status == "PENDING" or x is None or y is None or x == y or (min(x, y), max(x, y)) in pairs:
            continue
        group = next((g for g in groups if g in (x, y)), None)
        if group is None:
            group = master
            groups.append(master)
            founded.append((master, "AUTO_DUPLICATE" if status == "AUTO_DUPLICATE" else "NEEDS_REVIEW"))
        pairs.add((min(x, y), max(x, y)))
        new[min(x, y), max(x, y)] = (group, status, kind, confidence)
    return {(*k, *v) for k, v in new.items()}, set(founded)


def decisions(seed, n, records):
    rng = random.Random(seed)
    out = []
    for rank in range(n):
        x, y = rng.randrange(records), rng.randrange(records)
        status, kind = rng.choice([("AUTO_DUPLICATE", "EXACT_MATCH"), ("NEEDS_REVIEW", "POSSIBLE_MATCH"), ("PENDING", "NO_MATCH"), ("CONFLICT", "CONFLICT")])
        out.append((rank, x, y, rng.choice([x, y]), status, kind, 0.5))
    return [*out, (n, None, 1, 1, "CONFLICT", "CONFLICT", 0.5)]


@pytest.mark.parametrize("seed, n, records", [(1, 60, 12), (2, 120, 80), (3, 90, 30)])
def test_groups_are_those_of_one_pass(spark, seed, n, records):
    rows = decisions(seed, n, records)
    known = [(0, 1), (2, 5)]
    pairs, groups = assign(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(known, "a long, b long"), spark.createDataFrame([(1, 7), (5, 3)], "canonical long, created long"))
    expected_pairs, expected_groups = in_order(rows, known, [5, 1])
    assert {tuple(r) for r in pairs.collect()} == expected_pairs
    assert {tuple(r) for r in groups.collect()} == expected_groups
    # Running again adds nothing.
    all_pairs = spark.createDataFrame(known, "a long, b long").unionByName(pairs.select("a", "b"))
    all_groups = spark.createDataFrame([(1, 7), (5, 3)], "canonical long, created long").unionByName(groups.selectExpr("group_id AS canonical", "100L AS created"))
    again, founded = assign(spark.createDataFrame(rows, SCHEMA), all_pairs, all_groups)
    assert again.count() == 0 and founded.count() == 0


def test_nothing_to_do(spark):
    none = spark.createDataFrame([], SCHEMA)
    pairs, groups = assign(none, spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "canonical long, created long"))
    assert pairs.count() == 0 and groups.count() == 0
