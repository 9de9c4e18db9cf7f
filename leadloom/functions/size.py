"""Employee sizes in text, and fits against bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before a number that make it no exact one.
HEDGES = ("approximately", r"approx\.?", "about", "around", "roughly", "nearly", "over", "under", "at least", "more than", "fewer than", "up to")
#: What stands before a range, before a count and behind either; sizes that are told in words.
RANGE_LABEL, COUNT_LABELS, UNIT = r"company size ?:?", ("employee count", "number of employees", "(?<!number of )employees"), r"employees?\b"
#: Fixed value: characters on either side of a statement that are quoted with it.
EXCERPT = 80
SIZE_WORDS = r"\bsmall (?:company|business)\b"


def _patterns() -> dict[str, str]:
    """Patterns over text with single blanks, made of the fixed words. A count's pattern only matches where the count is usable."""
    hedge = rf"(?:\b(?:{'|'.join(HEDGES)}) ?|[0-9] ?\+ ?)"
    number, to = "([0-9]{1,6})", " ?(?:-|–|to) ?"
    no_range = " ?(?:-|–|to) ?[0-9]"
    return {
        # The first group is a hedge in front, if there is one.
        "labelled_range": rf"(?i)({hedge}?)\b{RANGE_LABEL} ?{number}{to}{number}\b",
        "range": rf"(?i)({hedge}?)\b{number}{to}{number} {UNIT}",
        "labelled_count": rf"(?i)(?<!{hedge})\b(?:{'|'.join(COUNT_LABELS)}) ?[:=]? ?{number}\b(?!{no_range})",
        "count": rf"(?i)(?<!{hedge})(?<![0-9.]){number} {UNIT}(?!{no_range}| [0-9])",
        "unusable": rf"(?i)\b(?:{'|'.join(HEDGES)}) [0-9]{{1,6}} {UNIT}|\b[0-9]{{1,6}}\+ {UNIT}|{SIZE_WORDS}",
    }


def extract(text: Column) -> Column:
    """A struct kind ('range', 'exact', 'unusable' or null), low and high.

    The first range decides, if there is one: with its ends the wrong way round it says nothing, behind a hedge
    it is unusable. Else the first count that stands behind a label without a hedge, then the first before
    the word employees. Else hedged or open counts and sizes in words are unusable.
    """
    wanted = _patterns()
    none = F.lit(None).cast("int")
    made = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
    whole = lambda flat, name: F.regexp_substr(flat, F.lit(wanted[name])).alias(name)

    def ends(said: Column, name: str) -> Column:
        hedge, low, high = (F.regexp_extract(said[name], wanted[name], i) for i in (1, 2, 3))
        return F.when(said[name].isNotNull(), F.struct(hedge.alias("hedge"), low.try_cast("int").alias("low"), high.try_cast("int").alias("high")))

    def of_range(r: Column) -> Column:
        return F.when(r["low"] > r["high"], made(None, none, none)).when(r["hedge"] != "", made("unusable", none, none)).otherwise(made("range", r["low"], r["high"]))

    def of_text(flat: Column) -> Column:
        count = F.coalesce(*(F.get(F.regexp_extract_all(flat, F.lit(wanted[name]), 1), F.lit(0)) for name in ("labelled_count", "count"))).try_cast("int")
        other = _with(count, lambda n: F.when(n.isNotNull(), made("exact", n, n)).when(flat.rlike(wanted["unusable"]), made("unusable", none, none)))
        # The groups of a range are taken from what its pattern matched, not from the whole text again.
        first = _with(F.struct(whole(flat, "labelled_range"), whole(flat, "range")), lambda said: F.coalesce(ends(said, "labelled_range"), ends(said, "range")))
        return _with(first, lambda r: F.when(r.isNotNull(), of_range(r)).otherwise(other))

    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return _with(_with(flat, of_text), lambda out: F.when(out["kind"].isNotNull(), out))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def relation(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """How the second span lies to the first: same, narrower, wider or conflict."""
    inside = (other_low >= low) & (other_high <= high)
    around = (low >= other_low) & (high <= other_high)
    return F.when(inside & around, "same").when(inside, "narrower").when(around, "wider").otherwise("conflict")


def reconcile(spans: Column) -> Column:
    """The narrowest of spans that lie one in another, in the order given; or the first two that conflict.

    `spans` is array<struct<low, high>>; the result has outcome ('none', 'value', 'conflict'), low, high, other_low, other_high.
    """
    state = "struct<outcome:string,low:int,high:int,other_low:int,other_high:int>"
    start = F.struct(F.lit("none").alias("outcome"), *(F.lit(None).cast("int").alias(x) for x in ("low", "high", "other_low", "other_high"))).cast(state)

    def step(s: Column, x: Column) -> Column:
        kind = relation(s["low"], s["high"], x["low"], x["high"])
        make = lambda outcome, a, b, c, d: F.struct(F.lit(outcome).alias("outcome"), a.alias("low"), b.alias("high"), c.cast("int").alias("other_low"), d.cast("int").alias("other_high")).cast(state)
        none = F.lit(None)
        return F.when(s["outcome"] == "conflict", s).when(s["outcome"] == "none", make("value", x["low"], x["high"], none, none)).when(kind == "conflict", make("conflict", s["low"], s["high"], x["low"], x["high"])).when(kind == "narrower", make("value", x["low"], x["high"], none, none)).otherwise(s)

    return F.aggregate(spans, start, step)


def parse_span(text: Column) -> tuple[Column, Column]:
    """Ends of `a-b`, `a–b` or `a to b` anywhere in a text."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"([0-9]+)\s*(?:-|–|to)\s*([0-9]+)", i), F.lit("")).try_cast("int")
    return part(1), part(2)


def fit(count: Column, span: Column, low: int | None, high: int | None) -> Column:
    """MATCHED, OUTSIDE_RANGE or UNKNOWN; a range matches only if it lies within the bounds."""
    low_, high_ = F.lit(low if low is not None else 0), F.lit(high if high is not None else 2147483647)
    a, b = parse_span(span)
    return (
        F.when(count.isNotNull(), F.when(count.between(low_, high_), "MATCHED").otherwise("OUTSIDE_RANGE"))
        .when((a >= low_) & (b <= high_), "MATCHED").when((b < low_) | (a > high_), "OUTSIDE_RANGE").otherwise("UNKNOWN")
    )


def excerpt(text: Column, around: int = EXCERPT) -> Column:
    """The words in which a text states a size, by the same patterns as extract(), with `around` characters on either side; null if it states none."""
    wanted = _patterns()
    names = ("labelled_range", "range", "labelled_count", "count", "unusable")

    def of_text(flat: Column) -> Column:
        said = F.coalesce(*(F.nullif(F.regexp_substr(flat, F.lit(wanted[name])), F.lit("")) for name in names))
        return _with(F.struct(flat.alias("flat"), said.alias("said")), of_words)

    def of_words(x: Column) -> Column:
        at = F.position(x["said"], x["flat"])
        begin = F.greatest(F.lit(1), at - around)
        return F.trim(F.substr(x["flat"], begin, at + F.length(x["said"]) + around - begin))

    return _with(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), of_text)
