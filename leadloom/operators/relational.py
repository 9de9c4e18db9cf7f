"""Building blocks that the lead queries share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key that more rows than these have is common: common keys come first when keys are put in order.
CUT = 1000
#: Rows in a part of a common key, on an average, and how many groups the parts of one key make: each two groups meet by themselves.
PART, GROUPS = 8192, 16
#: Ids that are paired with as many others at a time; all pairs of two chunks are held at once.
CHUNK = 64


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes last in `order`; an aggregate, so rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page; only its rows and those before it are kept while sorting."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and have 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(rows: DataFrame, counted: DataFrame, size: int) -> DataFrame:
    """A page's rows with the number of all rows and of pages."""
    total = counted.agg(F.count("*").alias("total"))
    # One row.
    return rows.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def intersect_ids(df: DataFrame, key: str, facets: Sequence[DataFrame]) -> DataFrame:
    """Rows whose key is in every facet; each facet has one column, the ids."""
    for facet in facets:
        name = facet.columns[0]
        df = df.join(facet.select(F.col(name).alias(key)), key, "left_semi")
    return df


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`existing` and the incoming rows with keys not there yet; of equal incoming keys the first in `order`."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    return existing.unionByName(first.join(existing.select(*keys), list(keys), "left_anti"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All keys; an incoming row replaces an existing one, and of incoming rows the last in `order` wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_by(both, keys, ["_new", *order]).drop("_new")


def remap(children: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """Children of merged entities pointed to their masters; `merged` has (loser, master)."""
    joined = children.join(merged, children[column] == merged["loser"], "left")
    return joined.withColumn(column, F.coalesce("master", column)).drop("loser", "master")


def pairs_once(rows: DataFrame, id_column: str, keys: Column) -> DataFrame:
    """Ordered pairs (a, b) of ids whose rows share any of `keys`, an array of strings; each pair once.

    A pair comes out at the first key that both share, the most common keys first, so pairs are never shuffled to drop repeated ones.
    Whether it does is told by the keys before that one alone: the rows of a key that have the same ones before it are a class, and classes
    are compared, not rows. Lists of a class's ids are all that moves: each goes to as many cells as its key has groups of parts, GROUPS at
    the most, so what is shuffled grows with rows and keys, and pairs are made where they come out, chunk by chunk: whole chunks follow one
    another in the same order, which keeps them small in columnar files.
    """
    spark = rows.sparkSession
    every = F.array_distinct(F.array_compact(F.flatten(F.array_compact(F.collect_list("keys")))))
    whole = rows.select(F.col(id_column).alias("id"), keys.alias("keys")).filter("id IS NOT NULL").groupBy("id").agg(every.alias("keys"))
    sizes = whole.select("id", F.explode("keys").alias("_key")).groupBy("_key").agg(F.count("*").alias("_n"), F.min("id").alias("id"))
    # Keys of one row make no pair and go before anything moves by key.
    lone = sizes.filter("_n = 1").groupBy("id").agg(F.collect_list("_key").alias("_lone"))
    shared = F.when(F.col("_lone").isNull(), F.col("keys")).otherwise(F.array_except("keys", "_lone"))
    one = whole.join(lone, "id", "left").select("id", F.explode(shared).alias("_key"))
    # At most one row for each CUT rows.
    common = F.broadcast(sizes.filter(F.col("_n") > CUT).select("_key", "_n"))
    order = F.array_sort(F.collect_list(F.struct((-F.coalesce("_n", F.lit(0))).alias("rank"), F.col("_key").alias("key"))))
    held = one.join(common, "_key", "left").groupBy("id").agg(order.alias("_order")).select("id", "_order", F.posexplode("_order").alias("_at", "_own"))
    before = F.transform(F.slice("_order", F.lit(1), F.col("_at")), lambda o: o["key"])
    parts = F.greatest(F.lit(1), F.ceil(-F.col("_own.rank") / PART)).cast("int")
    held = held.select("id", F.col("_own.key").alias("_key"), before.alias("_before"), parts.alias("_parts")).withColumn("_part", F.pmod(F.xxhash64("id"), "_parts").cast("int"))
    classes = held.groupBy("_key", "_before", "_parts", "_part").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    classes = classes.select("_key", "_before", "_ids", F.pmod("_part", F.lit(GROUPS)).alias("_group"), (F.least("_parts", F.lit(GROUPS)) - 1).alias("_last"))
    # Bytes say little about pairs, so that adaptive plans must not put cells together by them.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_ids") / CHUNK).cast("int") - 1), lambda i: F.slice("_ids", i * CHUNK + 1, CHUNK))

    def cells(low: Column, high: Column, suffix: str) -> DataFrame:
        dealt = classes.withColumn("_to", F.explode(F.sequence(low, high))).withColumns({"_low": F.least("_group", "_to"), "_high": F.greatest("_group", "_to")})
        dealt = dealt.select("_key", "_low", "_high", "_before", "_ids").repartition(tasks, "_key", "_low", "_high")
        return dealt.select("_key", "_low", "_high", F.col("_before").alias("_before" + suffix), F.explode(chunks).alias("_ids" + suffix))

    # A group meets itself in the order of ids, and two groups meet once, in full.
    itself = F.col("_low") == F.col("_high")
    met = (~itself | (F.get("_ids1", F.lit(0)) < F.element_at("_ids2", -1))) & ((F.size("_before1") == 0) | ~F.arrays_overlap("_before1", "_before2"))
    joined = cells(F.col("_group"), F.col("_last"), "1").join(cells(F.lit(0), F.col("_group"), "2"), ["_key", "_low", "_high"]).filter(met)
    made = joined.select(F.explode("_ids1").alias("x"), F.col("_ids2").alias("_y"), itself.alias("_itself")).select("x", F.explode("_y").alias("y"), "_itself")
    return made.filter(~F.col("_itself") | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def block_pairs(df: DataFrame, id_column: str, keys: dict[str, Column]) -> DataFrame:
    """Distinct ordered pairs (a, b) of rows that share any key: an equi-join on exploded keys, never an OR."""
    listed = F.array(*(F.when(key.cast("string") != "", F.concat(F.lit(f"{i}:"), key.cast("string"))) for i, key in enumerate(keys.values())))
    return pairs_once(df, id_column, listed)


def block_stars(df: DataFrame, id_column: str, keys: dict[str, Column]) -> DataFrame:
    """Pairs (a, b) of each row b with the smallest id a that shares a key with it: as many pairs as rows and keys, however many share one.

    Each row is brought together with the head of its keys alone: enough to find what hangs together, not to decide on every pair,
    for which block_classes is.
    """
    listed = F.array(*(F.struct(F.lit(name).alias("kind"), key.cast("string").alias("key")) for name, key in keys.items()))
    one = df.select(F.col(id_column).alias("b"), F.explode(listed).alias("k")).select("b", "k.kind", "k.key").filter("key IS NOT NULL AND key <> ''").distinct()
    heads = one.groupBy("kind", "key").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return one.join(heads, ["kind", "key"]).filter("a < b").select("a", "b").distinct()


def signature_classes(df: DataFrame, id_column: str) -> DataFrame:
    """Rows that differ in their id alone as one: the smallest id, and how many there are in `members`."""
    rest = [c for c in df.columns if c != id_column]
    return df.groupBy(*rest).agg(F.min(id_column).alias(id_column), F.count("*").alias("members")).select(id_column, *rest, "members")


def block_classes(classes: DataFrame, id_column: str, keys: Column) -> DataFrame:
    """Pairs (a, b) of classes that share a key, and (a, a) of each class with several members and any key.

    `keys` is an array of structs of kind and key; null and empty keys are none. No link between different rows is lost, and rows
    that differ in nothing make one pair, however many they are.
    """
    one = classes.select(F.col(id_column).alias("a"), "members", F.explode(keys).alias("k")).filter("k.key IS NOT NULL AND k.key <> ''").select("a", "members", "k.kind", "k.key").distinct()
    other = one.select(F.col("a").alias("b"), "kind", "key")
    return one.join(other, ["kind", "key"]).filter("a < b OR (a = b AND members > 1)").select("a", "b").distinct()


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column) -> DataFrame:
    """`streak`: how many rows in a row, up to this one, had no hit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_island", F.sum(F.when(hit, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.when(hit, 0).otherwise(1)).over(own)).drop("_island")


def once_each(df: DataFrame, columns: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with what `work` adds to `columns`: done once for each distinct combination of their values, and joined back to all rows.

    `work` gets the combinations under the names _once0, _once1 and so on and adds columns, which replace those of `df`. The combinations
    are dealt out evenly first, since costly work on few or small rows would otherwise stand in one task. `df` is read twice.
    """
    once = [f"_once{i}" for i in range(len(columns))]
    # Few tasks a core: each has to read a large plan first.
    parts = 3 * df.sparkSession.sparkContext.defaultParallelism
    done = work(df.select(*(F.col(c).alias(k) for c, k in zip(columns, once))).distinct().repartition(parts))
    own = {f"_own{i}": F.col(c) for i, c in enumerate(columns)}
    rows = df.withColumns(own).drop(*(c for c in done.columns if c not in once))
    match = reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, once)))
    return rows.join(done, match).drop(*own, *once)
