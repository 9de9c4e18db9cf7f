"""Personal data spans with Spark SQL functions alone: rules, weak supervision and a span classifier.

Strict rules give the base spans. Looser rules give further candidates. Regex, checksum, gazetteer,
context and boundary labelers vote on every candidate; expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is, and so how likely each pattern is personal data.
A naive Bayes classifier on the candidates' shapes and surroundings is fitted to these estimates and
decides which further candidates are spans; base spans always stay.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import set_aside, stage

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: Strict patterns. Possessive repeats and the look-behind find the same matches as plain ones, in linear time.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a strict pattern to be tried.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: Looser patterns: spelt-out addresses, national phone numbers. (Numbers that fail the card checksum are candidates too.)
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}",
    "phone": r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
LOOSE_HINT = {"email": r"(?i)[ (\[]dot[ )\]]", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
#: Gazetteers: common top-level domains, first digits of card numbers, country calling codes.
GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|eu|us|ch|at|nl|ca)$",
    "card": r"^(4|5[1-5]|2[2-7]|34|37|36|30|6)",
    "phone": r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "ip": r"^([1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
}
#: Words before a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)(mail|contact|write|address|@)\W{0,4}\w{0,4}\W{0,4}$",
    "ip": r"(?i)(\bip\b|server|host|address|login|from)\W{0,4}\w{0,4}\W{0,4}$",
    "card": r"(?i)(card|visa|master|amex|credit|debit|payment|account)\W{0,4}\w{0,6}\W{0,4}$",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|dial|contact)\W{0,4}\w{0,6}\W{0,4}$",
}
#: Digits of a span from which on their number tells no more.
MOST_DIGITS = 20
#: Characters around a span that are looked at.
AROUND = 32
MARK = "\x01"
VOTES = ("regex", "checksum", "gazetteer", "context", "boundary")
FEATURES = ("f_left", "f_right", "f_size", "f_shape")
ROUNDS = 40

FOUND = "array<struct<start:int,end:int,body:string,before:string,after:string>>"


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Each match with its place in code points and its surroundings; the text must not hold MARK."""
    # Parts at odd places are matches: every match is put between two marks.
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast(FOUND).alias("found"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        span = F.struct(
            state["at"].alias("start"), end.alias("end"), part.alias("body"),
            F.substring(text, F.greatest(F.lit(1), state["at"] - AROUND + 1), F.least(state["at"], F.lit(AROUND))).alias("before"), F.substring(text, end + 1, F.lit(AROUND)).alias("after"),
        )
        found = F.when(state["n"] % 2 == 1, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), (state["n"] + 1).alias("n"), found.alias("found"))

    return F.when(text.rlike(hint), F.aggregate(parts, start, step, lambda s: s["found"])).otherwise(F.array().cast(FOUND))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn checksum."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, body: Column) -> Column:
    """Whether a strict match is a base span."""
    size = F.length(_digits(body))
    if kind == "ip":
        return body.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return size.between(12, 19) & _luhn(_digits(body))
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _described(kind: str, span: Column, base: Column, strict: bool) -> Column:
    """A candidate: its kind and place, the labelers' votes (1 for, -1 against, 0 none), the classifier's features."""
    body, digits = span["body"], _digits(span["body"])
    glued = span["before"].rlike(r"[A-Za-z0-9_]$") | span["after"].rlike(r"^[A-Za-z0-9_]")
    checksum = {
        "email": _vote(body.rlike(r"[. ][A-Za-z]{2,24}$"), body.rlike(r"[0-9-]$")),
        "ip": _vote(~body.rlike(r"^(0|127|255)\.") & base, ~base),
        "card": _vote(base, ~base),
        "phone": _vote(F.length(digits).between(10, 13), ~F.length(digits).between(9, 15)),
    }[kind]
    votes = {
        "regex": F.when(base, 1).otherwise(0),
        "checksum": checksum,
        "gazetteer": _vote(F.lower(body if kind in ("email", "ip") else digits).rlike(GAZETTEER[kind]), F.lit(kind in ("card", "phone", "ip"))),
        "context": F.when(span["before"].rlike(CONTEXT[kind]), 1).otherwise(0),
        "boundary": _vote(~glued, glued),
    }
    sort_of = lambda c: F.when(c == "", "edge").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "blank").otherwise("other")
    return F.struct(
        span["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), span["end"].alias("end"), F.lit(kind).alias("kind"), base.alias("base"),
        *(votes[v].cast("int").alias(v) for v in VOTES),
        sort_of(F.substring(span["before"], -1, 1)).alias("f_left"), sort_of(F.substring(span["after"], 1, 1)).alias("f_right"),
        F.least(F.length(digits), F.lit(MOST_DIGITS)).cast("string").alias("f_size"), F.lit("strict" if strict else "loose").alias("f_shape"),
    )


def candidates(docs: DataFrame, text: str = "text", column: str = "candidates") -> DataFrame:
    """The documents with `column`: all candidates of the whole text, base and looser, by start and kind."""
    body = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, "\x02")
    docs, back = set_aside(docs, ["_pii_text", *(f"_pii_{k}" for k in KINDS), *(f"_pii_loose_{k}" for k in LOOSE)])
    docs = docs.withColumn("_pii_text", body)
    lists, names = [], []
    for kind in KINDS:
        docs = docs.withColumn(f"_pii_{kind}", _matches(F.col("_pii_text"), STRICT[kind], HINT[kind]))
        names.append(f"_pii_{kind}")
        usable = F.col(names[-1])
        if kind == "card":
            usable = F.filter(usable, lambda s: F.length(_digits(s["body"])).between(12, 19))
        described = F.transform(usable, lambda s: _described(kind, s, _valid(kind, s["body"]), True))
        # Of strict matches that are no base span only numbers with a card's length go on.
        lists.append(described if kind == "card" else F.filter(described, lambda s: s["base"]))
    for kind, pattern in LOOSE.items():
        docs = docs.withColumn(f"_pii_loose_{kind}", _matches(F.col("_pii_text"), pattern, LOOSE_HINT[kind]))
        names.append(f"_pii_loose_{kind}")
        # What overlaps a strict match of its kind is no candidate of its own.
        apart = F.filter(F.col(names[-1]), lambda s: ~F.exists(F.col(f"_pii_{kind}"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        lists.append(F.transform(apart, lambda s: _described(kind, s, F.lit(False), False)))
    return back(docs.withColumn(column, F.array_sort(F.concat(*lists))).drop("_pii_text", *names))


@dataclass
class Model:
    """Log odds of personal data: by kind, and by kind, feature and value."""

    prior: dict[str, float]
    odds: dict[str, float]


def estimate(patterns: dict[tuple, float]) -> dict[tuple, float]:
    """How likely each pattern of votes is personal data, by expectation-maximisation over all patterns' counts."""
    likely = {p: 1 / (1 + math.exp(-sum(p))) for p in patterns}
    for _ in range(ROUNDS):
        sums = [defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)]
        mass = [1.0, 1.0]
        for p, n in patterns.items():
            for y, w in ((1, likely[p] * n), (0, (1 - likely[p]) * n)):
                mass[y] += w
                for j, v in enumerate(p):
                    sums[y][j, v] += w
        for p in patterns:
            z = math.log(mass[1] / mass[0])
            for j, v in enumerate(p):
                z += math.log(sums[1][j, v] / (mass[1] + 2)) - math.log(sums[0][j, v] / (mass[0] + 2))
            likely[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return likely


def fit(found: DataFrame, column: str = "candidates") -> Model:
    """The classifier for all candidates: only counts by kind, votes and features reach the driver (their combinations are few and fixed)."""
    one = found.select(F.explode(column).alias("c")).select("c.kind", *(f"c.{v}" for v in VOTES), *(f"c.{f}" for f in FEATURES))
    counted = one.groupBy(*one.columns).agg(F.count("*").alias("n"))
    rows = counted.collect()
    model = Model({}, {})
    for kind in KINDS:
        own = [r for r in rows if r["kind"] == kind]
        patterns: dict[tuple, float] = defaultdict(float)
        for r in own:
            patterns[tuple(r[v] for v in VOTES)] += r["n"]
        likely = estimate(patterns)
        mass = {1: 1.0, 0: 1.0}
        sums: dict[tuple, float] = defaultdict(lambda: 1.0)
        for r in own:
            p = likely[tuple(r[v] for v in VOTES)]
            for y, w in ((1, p * r["n"]), (0, (1 - p) * r["n"])):
                mass[y] += w
                for f in FEATURES:
                    sums[y, f, r[f]] += w
                for v in VOTES[1:]:
                    sums[y, v, str(r[v])] += w
        model.prior[kind] = math.log(mass[1] / mass[0])
        for _, f, value in list(sums):
            size = len({x for y, g, x in sums if g == f})
            model.odds[f"{kind}/{f}/{value}"] = math.log(sums[1, f, value] / (mass[1] + size)) - math.log(sums[0, f, value] / (mass[0] + size))
    return model


def classify(found: DataFrame, model: Model, column: str = "candidates") -> DataFrame:
    """`column` as the spans: base candidates, and those that the classifier takes for personal data (`score` over 0.5)."""
    prior = F.create_map(*(F.lit(x) for kv in model.prior.items() for x in kv))
    odds = F.create_map(*(F.lit(x) for kv in (model.odds or {"": 0.0}).items() for x in kv))

    def score(c: Column) -> Column:
        parts = [F.coalesce(F.try_element_at(odds, F.concat(c["kind"], F.lit(f"/{f}/"), c[f].cast("string"))), F.lit(0.0)) for f in (*FEATURES, *VOTES[1:])]
        return 1 / (1 + F.exp(-sum(parts, F.coalesce(F.try_element_at(prior, c["kind"]), F.lit(0.0)))))

    scored = F.transform(F.col(column), lambda c: F.struct(c["start"], c["rank"], c["end"], c["kind"], c["base"], score(c).alias("score")))
    return found.withColumn(column, F.filter(scored, lambda c: c["base"] | (c["score"] > 0.5)))


def find(docs: DataFrame, model: Model | None = None, column: str = "spans") -> DataFrame:
    """The documents with `column`, array<struct<start, rank, end, kind, base, score>>: the personal data in their whole texts.

    Places count code points, ends are exclusive; spans come by start and kind. A column of that name
    is replaced. Null and empty texts have none; very long ones are searched whole; rows that repeat are searched
    each by itself; without a model one is fitted to these documents. An empty table gives no rows.
    """
    if model is None:
        model = fit(stage(candidates(docs.select("text")).select("candidates"), "pii"))
    return classify(candidates(docs.drop(column), column=column), model, column)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with each span's text replaced by <kind>; of overlapping spans the first one counts."""
    docs, back = set_aside(docs, ["_pii_spans"])
    found = find(docs, model, "_pii_spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce("text", F.lit(""))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
        replaced = F.struct(s["end"].alias("at"), F.concat(state["out"], kept, F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        return F.when(s["start"] >= state["at"], replaced).otherwise(state)

    masked = F.aggregate("_pii_spans", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return back(found.withColumn("text", F.when(F.size("_pii_spans") > 0, masked).otherwise(F.col("text"))).drop("_pii_spans"))
