"""Decisions on pairs made lasting: each pair once, in the group that has one of its two as its canonical record.

Decisions come one after another, and a pair that no group takes founds one, whose canonical record is the pair's master. So whether
a pair founds a group depends on all pairs before it that would make one of its two canonical. This is settled in
rounds over all pairs: a pair founds a group when no open pair before it could take it; a pair that a founder before it takes is closed.
There are as many rounds as the longest chain of pairs that wait for one another. Groups are not transitive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.settle import settled

#: What is kept of a decision.
KEPT = ("status", "match_type", "confidence")


def _ends(pairs: DataFrame) -> DataFrame:
    """Each pair at each of its two records."""
    return pairs.select("rank", F.explode(F.array("a", "b")).alias("record"))


def assign(decisions: DataFrame, known_pairs: DataFrame, known_groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new pairs, new groups) of decisions in ascending `rank`.

    `decisions` has rank (unique), record_a, record_b, master (one of both), status, match_type and confidence; `known_pairs` has a and b in
    ascending order; `known_groups` has canonical and created. Pairs of NO_MATCH or PENDING are not kept, nor are known ones, and
    of decisions on one pair the first counts. A new pair is (a, b, group_id, status, match_type, confidence), a new group
    (group_id, status): a group's id is its canonical record, of which there is one group at most. A pair whose two both are
    canonical goes to the group that was there first. Decisions with a null record are left out; running again adds nothing.
    """
    kept = decisions.filter("match_type <> 'NO_MATCH' AND status <> 'PENDING' AND record_a IS NOT NULL AND record_b IS NOT NULL AND record_a <> record_b")
    ordered = kept.select(F.least("record_a", "record_b").alias("a"), F.greatest("record_a", "record_b").alias("b"), "rank", "master", *KEPT)
    first = ordered.groupBy("a", "b").agg(F.min_by(F.struct("rank", "master", *KEPT), "rank").alias("d")).select("a", "b", "d.*")
    pairs = settled(first.join(known_pairs.select("a", "b"), ["a", "b"], "left_anti"))
    # Groups that are there take pairs whenever these come.
    taken = settled(_ends(pairs).join(known_groups.select(F.col("canonical").alias("record")), "record", "left_semi").select("rank").distinct())
    open_ = settled(pairs.select("rank", "a", "b", "master").join(taken, "rank", "left_anti"))
    founders = None
    while not open_.isEmpty():
        # Of the open pairs that would make a record canonical, the first.
        claims = open_.groupBy(F.col("master").alias("record")).agg(F.min("rank").alias("earliest"))
        ends = _ends(open_)
        waits = ends.join(claims, "record").filter(F.col("earliest") < F.col("rank")).select("rank").distinct()
        found = settled(open_.join(waits, "rank", "left_anti").select("rank", "master"))
        founders = found if founders is None else founders.unionByName(found)
        # A founder takes only pairs behind it; one before it has been waiting for nothing of its own and is a founder too, or waits for others.
        closed = ends.join(found.select(F.col("master").alias("record"), F.col("rank").alias("founded")), "record").filter(F.col("founded") < F.col("rank")).select("rank").distinct()
        open_ = settled(open_.join(found.select("rank"), "rank", "left_anti").join(closed, "rank", "left_anti"))
    if founders is None:
        founders = pairs.select("rank", "master").limit(0)
    founders = settled(founders)
    groups = known_groups.select(F.col("canonical").alias("record"), F.struct(F.lit(0).alias("new"), F.col("created").cast("long").alias("at")).alias("since"))
    groups = groups.unionByName(founders.select(F.col("master").alias("record"), F.struct(F.lit(1).alias("new"), F.col("rank").cast("long").alias("at")).alias("since")))
    reach = _ends(pairs).join(groups, "record").filter((F.col("since.new") == 0) | (F.col("since.at") <= F.col("rank")))
    chosen = reach.groupBy("rank").agg(F.min_by("record", "since").alias("group_id"))
    new_pairs = pairs.join(chosen, "rank").select("a", "b", "group_id", *KEPT)
    status = F.when(F.col("status") == "AUTO_DUPLICATE", "AUTO_DUPLICATE").otherwise("NEEDS_REVIEW")
    return new_pairs, pairs.join(founders.select("rank"), "rank").select(F.col("master").alias("group_id"), status.alias("status"))
