"""Names in texts against a look at every place of every text."""

import random

import pytest

from leadloom.functions.gazetteer import entries
from leadloom.operators import place_scan


def everywhere(text, names):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = []
    for name in names:
        for at in range(len(low)):
            if low.startswith(name, at) and not (at and low[at - 1].isalnum()) and not low[at + len(name) : at + len(name) + 1].isalnum():
                found.append((at, at + len(name), name))
    return {x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found)}


def test_mentions_are_all_there_are(spark):
    names = sorted({e[0] for e in entries()})
    rng = random.Random(6)
    words = [*names, "New York City", "yorkshire", "x", "é", "the", ",", "San", "TEXAS", "united", "states"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["Dubai", "dubaiX", "xdubai", "Dubai-Dubai", "New York, NEW YORK", "İ Paris", None, "", "paris" * 3]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, "Oman", "n")]
    listed = spark.createDataFrame([(n,) for n in names] + [("PARIS",), (None,), ("",)], "name string")
    got = sorted(map(tuple, place_scan.mentions(spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(3), listed).collect()), key=str)
    assert got == sorted([(i, n, a, b) for i, t, _ in rows for a, b, n in everywhere(t, names)], key=str)


def test_no_names_and_too_many(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Paris")], "doc_id long, text string")
    assert place_scan.mentions(texts, spark.createDataFrame([], "name string")).count() == 0
    monkeypatch.setattr(place_scan, "MOST_BYTES", 3)
    with pytest.raises(ValueError):
        place_scan.mentions(texts, spark.createDataFrame([("paris",)], "name string"))
