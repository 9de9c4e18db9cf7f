"""Discovery: URL gate, duplicates among candidates, yield of query families, places."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.urls import host
from leadloom.operators.relational import pairs_once, streaks
from leadloom.operators.settle import settled

#: Hosts that are no company's own site, by class; the first class that has a host counts.
HOST_CLASSES = {
    "SOCIAL_PROFILE": ("linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com", "threads.net"),
    "REVIEW_SITE": (
        "yelp.com", "yellowpages.com", "tripadvisor.com", "glassdoor.com", "trustpilot.com", "angi.com", "thumbtack.com", "bbb.org", "g2.com", "capterra.com", "sitejabber.com",
        "clutch.co", "goodfirms.co", "sortlist.com", "designrush.com",
    ),
    "DIRECTORY": (
        "crunchbase.com", "zoominfo.com", "opencorporates.com", "manta.com", "dnb.com", "pitchbook.com", "owler.com", "rocketreach.co", "apollo.io", "signalhire.com", "datanyze.com",
        "cbinsights.com", "craft.co", "buzzfile.com", "corporationwiki.com", "bizapedia.com", "kompass.com", "hoovers.com", "startupintros.com", "indeed.com", "ziprecruiter.com",
        "monster.com", "simplyhired.com", "careerbuilder.com",
    ),
    "PROXY_OR_FILING": ("proxyvote.com", "sec.gov", "sedar.com", "sedarplus.ca", "bamsec.com", "last10k.com", "annualreports.com", "edgar-online.com", "secfilings.com", "companieshouse.gov.uk"),
    "NEWS_ARTICLE": (
        "reuters.com", "apnews.com", "nytimes.com", "wsj.com", "forbes.com", "cnbc.com", "marketwatch.com", "yahoo.com", "seekingalpha.com", "prnewswire.com", "businesswire.com",
        "globenewswire.com", "techcrunch.com", "ft.com", "bizjournals.com", "axios.com",
    ),
    "MARKETPLACE": ("amazon.com", "ebay.com", "etsy.com", "apps.apple.com", "play.google.com"),
    "GENERIC_THIRD_PARTY_PAGE": ("wikipedia.org", "wikidata.org", "bloomberg.com", "quora.com", "medium.com", "blogspot.com", "blogger.com", "wordpress.com", "substack.com", "reddit.com", "homelight.com"),
}
#: First words of paths that lead to articles, directories and lists.
LIST_PATHS = (
    "blog", "blogs", "directory", "directories", "guide", "guides", "article", "articles", "answer", "answers", "question", "questions", "profile", "profiles", "agencies", "companies",
    "review", "reviews", "ranking", "rankings",
)
#: Zero-yield batches in a row after which a family that is not required is left.
STOP_AFTER = 3
#: Degrees of latitude and longitude within which places may be one.
NEAR = 0.02


def host_class(name: Column) -> Column:
    """The class of a host or of the site that it is under; null for any other."""
    out = F.when(name.isNull(), None)
    for kind, hosts in HOST_CLASSES.items():
        out = out.when(name.rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in hosts) + ")$"), kind)
    return out


def reject_url(url: Column) -> Column:
    """Why a URL is no candidate's site; null if it may be one, or if there is none. Without a scheme it is read as https."""
    whole = F.when(url.contains("://"), F.trim(url)).otherwise(F.concat(F.lit("https://"), F.trim(url)))
    readable = whole.rlike("(?i)^https?://") & F.try_parse_url(whole, F.lit("HOST")).isNotNull()
    path = F.coalesce(F.try_parse_url(whole, F.lit("PATH")), F.lit(""))
    listed = F.when(path.rlike(rf"(?i)/({'|'.join(LIST_PATHS)})\b"), "GENERIC_LIST")
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", None).when(~readable, "INVALID_URL").otherwise(F.coalesce(host_class(host(whole)), listed))


def reject_candidate(website: Column, source: Column) -> Column:
    """Why a candidate may not be stored: the first of its URLs that is rejected tells."""
    return F.coalesce(reject_url(website), reject_url(source))


def identity_keys(external_id: Column, website: Column, name: Column, city: Column, state: Column) -> Column:
    """What makes two candidates one: id, site, or name and place."""
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    place = F.when((tidy(name) != "") & (F.trim(city) != ""), F.concat(F.lit("place:"), tidy(name), F.lit("|"), F.lower(F.trim(city)), F.lit("|"), F.lower(F.trim(F.coalesce(state, F.lit(""))))))
    keys = F.array(F.when(external_id != "", F.concat(F.lit("id:"), external_id)), F.concat(F.lit("website:"), host(F.nullif(website, F.lit("")))), place)
    return F.array_compact(keys)


def duplicate_pairs(candidates: DataFrame) -> DataFrame:
    """Ordered pairs of candidates (id, keys) that share a key, each once."""
    return pairs_once(candidates, "id", F.col("keys"))


def completeness(*fields: Column) -> Column:
    """How many of a candidate's fields are filled."""
    return sum((F.when(f != "", 1).otherwise(0) for f in fields), F.lit(0))


def first_wins(candidates: DataFrame, block: str | None = None, order: Sequence[str | Column] = ()) -> DataFrame:
    """Candidates by `order`, then id, that share no key with one accepted before; of one block, if that is given.

    A dropped candidate's keys are not remembered, so the result depends on the order. Worked in rounds
    over all rows: a candidate that comes first on each of its keys is accepted, those that share a key
    with it go, and the rest are judged anew, until none is left. There are as many rounds as the longest
    chain of decisions that wait for one another, few unless keys are chained in the very order of the rows.
    """
    whole = settled(candidates.withColumn("_row", F.monotonically_increasing_id()))
    # Rows without an id come last; equal ones keep the order in which they were read.
    rank = F.struct(*order, F.col("id").isNull().alias("_last"), "id", "_row").alias("_rank")
    scope = (F.col(block) if block else F.lit(0)).alias("_scope")
    left = whole.select("_row", rank, scope, F.explode(F.array_distinct("keys")).alias("_k")).select("_row", "_rank", F.struct("_scope", "_k").alias("_key"))
    left = settled(left)
    dropped = []
    while not left.isEmpty():
        firsts = left.groupBy("_key").agg(F.min("_rank").alias("_first"))
        judged = left.join(firsts, "_key").withColumn("_leads", F.col("_first").eqNullSafe(F.col("_rank")))
        accepted = settled(judged.groupBy("_row").agg(F.bool_and("_leads").alias("_leads")).filter("_leads").select("_row"))
        taken = left.join(accepted, "_row", "left_semi").select("_key")
        open_ = left.join(accepted, "_row", "left_anti")
        out = settled(open_.join(taken, "_key", "left_semi").select("_row").distinct())
        dropped.append(out)
        left = settled(open_.join(out, "_row", "left_anti"))
    gone = reduce(DataFrame.unionByName, dropped) if dropped else whole.select("_row").limit(0)
    return whole.join(gone, "_row", "left_anti").select(*candidates.columns)


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left.id, right.id) that lie within NEAR degrees: an equi-join on grid cells, then the exact test.

    Both have id, lat and lon. A row on the left stands in the nine cells around it.
    """
    cell = lambda c: F.floor(F.col(c) / NEAR)
    around = left.select(F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1)).alias("x"), cell("lon").alias("_y"))
    around = around.select("a", "lat_a", "lon_a", "x", F.explode(F.sequence(F.col("_y") - 1, F.col("_y") + 1)).alias("y"))
    own = right.select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), cell("lat").alias("x"), cell("lon").alias("y"))
    return around.join(own, ["x", "y"]).filter((F.abs(F.col("lat_a") - F.col("lat_b")) <= NEAR) & (F.abs(F.col("lon_a") - F.col("lon_b")) <= NEAR)).select("a", "b")


def earlier_neighbours(points: DataFrame, within: float) -> DataFrame:
    """For each point (id, lat, lon) that has any: how many points of smaller ids lie within that many degrees (at most NEAR), and the sum of their ids.

    Points of one place are neighbours of the same places, so places are paired, not points: every point goes to the places around it,
    where a running count in the order of ids has those before it. Rows grow with points and places, not with pairs of points.
    """
    spot = F.struct("lat", "lon")
    places = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select(spot.alias("id"), "lat", "lon").distinct()
    close = lambda x: F.abs(F.col(f"a.{x}") - F.col(f"b.{x}")) <= within
    around = near_pairs(places, places).filter(close("lat") & close("lon"))
    moved = points.withColumn("_at", spot).join(around, F.col("_at") == F.col("a")).select(F.col("b").alias("_place"), "id", (F.col("_at") == F.col("b")).alias("_own"))
    before = Window.partitionBy("_place").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)
    run = moved.withColumns({"n": F.count("*").over(before), "total": F.sum("id").over(before)})
    return run.filter("_own AND n > 0").select("id", "n", "total")


def boxes_of_points(points: DataFrame, boxes: DataFrame, cell: float = 1.0) -> DataFrame:
    """(point, box) for each point in a box (south, west, north, east, ends included): boxes are cut into grid cells."""
    tiles = boxes.select(F.col("id").alias("box"), "south", "west", "north", "east", F.explode(F.sequence(F.floor(F.col("south") / cell), F.floor(F.col("north") / cell))).alias("x"))
    tiles = tiles.select("box", "south", "west", "north", "east", "x", F.explode(F.sequence(F.floor(F.col("west") / cell), F.floor(F.col("east") / cell))).alias("y"))
    own = points.select(F.col("id").alias("point"), "lat", "lon", F.floor(F.col("lat") / cell).alias("x"), F.floor(F.col("lon") / cell).alias("y"))
    return own.join(tiles, ["x", "y"]).filter(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))).select("point", "box")


def yields(batches: DataFrame) -> DataFrame:
    """Totals of each family, place and category, and of all: one pass with grouping sets.

    `batches` has family, place, category, raw, accepted, duplicates and rejected.
    """
    sums = [F.sum(c).alias(c) for c in ("raw", "accepted", "duplicates", "rejected")]
    family, place, category = F.col("family"), F.col("place"), F.col("category")
    return batches.groupingSets([[family], [place], [category], []], family, place, category).agg(*sums, F.count("*").alias("batches"), F.round(F.sum("accepted") / F.count("*"), 4).alias("yield_per_query"))


def zero_streaks(batches: DataFrame) -> DataFrame:
    """For each family its streak of batches without a new company at the end, and whether it is left."""
    marked = streaks(batches, ["family"], ["batch"], F.col("accepted") > 0)
    last = marked.groupBy("family").agg(F.max_by("streak", "batch").alias("streak"), F.bool_or("required").alias("required"))
    return last.withColumn("skip", ~F.col("required") & (F.col("streak") >= STOP_AFTER))


def priority(raw: Column, accepted: Column, duplicates: Column, rejected: Column, required: Column, issued: Column) -> Column:
    """What a family's remaining queries are worth: only new companies raise it, and a required family without a query comes first."""
    noise = F.when((raw > 0) & (accepted == 0), raw * 3).otherwise(0)
    return F.when(required & (issued == 0), 1000).otherwise(accepted * 100 - duplicates * 15 - rejected * 2 - noise + F.when(required, 25).otherwise(0))


def places_agree(city: Column, lat: Column, lon: Column, other_city: Column, other_lat: Column, other_lon: Column) -> Column:
    """Whether two places may be one: the same city if both are known, and within NEAR degrees if both have coordinates."""
    tidy = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    cities = (tidy(city) == "") | (tidy(other_city) == "") | (tidy(city) == tidy(other_city))
    unknown = lat.isNull() | lon.isNull() | other_lat.isNull() | other_lon.isNull()
    return cities & (unknown | ((F.abs(lat - other_lat) <= NEAR) & (F.abs(lon - other_lon) <= NEAR)))


def agreeing(found: DataFrame, stored: DataFrame, keys: Sequence[str], sums: dict[str, Column], merge: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Each row of `found` with `sums` over all rows of `stored` that have its `keys` and whose place may be the same, as places_agree() says; rows without any are left out.

    Both have city, lat and lon beside the keys; found has id. `sums` are aggregates of stored rows and `merge` puts partial ones together, by name. What agrees
    is told by equal keys: of cities, with one for none and one for any, and of grid cells. Stored rows are summed by them
    first, so that a very common key costs one row for each that looks for it, whatever stands behind it; only rows with
    coordinates in the same or the next cell are compared by themselves.
    """
    tidy = F.lower(F.trim(F.coalesce(F.col("city"), F.lit(""))))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    # A little wider than the bound, so that rounding never puts near places two cells apart. What is no degree, or no number, shares the cells at the ends.
    cell = lambda c, step=0: F.floor(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.col(c))) / (NEAR * 1.001)) + step
    name = lambda x, y: F.concat_ws(":", x.cast("string"), y.cast("string"))
    around = F.array(*(name(cell("lat", x), cell("lon", y)) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    any_, none = F.lit("*"), F.lit("none")
    # A stored row answers to its city (or to none) and to any; to any cell, and to those around it or to none.
    offered = stored.withColumns({"_city": F.explode(F.array(F.concat(F.lit("="), tidy), any_))}).withColumn("_cell", F.explode(F.when(known, F.concat(F.array(any_), around)).otherwise(F.array(any_, none))))
    exact = F.col("_cell").contains(":")
    offered = offered.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), "_city", "_cell", F.when(exact, F.col("lat")).alias("_lat"), F.when(exact, F.col("lon")).alias("_lon")).agg(*(c.alias(k) for k, c in sums.items()))
    cities = F.when(tidy == "", F.array(any_)).otherwise(F.array(F.concat(F.lit("="), tidy), F.lit("=")))
    cells = F.when(known, F.array(none, name(cell("lat"), cell("lon")))).otherwise(F.array(any_))
    wanted = found.select("id", "lat", "lon", *keys, F.explode(cities).alias("_c"), cells.alias("_x")).withColumn("_x", F.explode("_x"))
    match = (F.col("_c") == F.col("_city")) & (F.col("_x") == F.col("_cell"))
    for k in keys:
        match &= F.col(k) == F.col(f"_{k}")
    near = F.col("_lat").isNull() | ((F.abs(F.col("lat") - F.col("_lat")) <= NEAR) & (F.abs(F.col("lon") - F.col("_lon")) <= NEAR))
    return wanted.join(offered, match).filter(near).groupBy("id").agg(*(merge[k](k).alias(k) for k in sums))


def provider_outcomes(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts of each key by outcome, and one status for all."""
    out = attempts.groupBy(*keys).agg(F.count("*").alias("attempted"), *(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("SUCCEEDED", "EMPTY", "FAILED", "SKIPPED")))
    status = F.when(F.col("succeeded") > 0, F.when(F.col("failed") > 0, "PARTIAL").otherwise("COMPLETED")).when(F.col("failed") == F.col("attempted"), "FAILED").when(F.col("skipped") == F.col("attempted"), "SKIPPED").otherwise("EMPTY")
    return out.withColumn("status", status)
