"""What models wrote, as typed rows: classifications that must have a shape, and lists of companies in whatever form they came.

No text makes a job fail: what cannot be read becomes a row with the reason. JSON is held as VARIANT values; text that
was cut off is read by a fold over its brackets, which keeps what had been closed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.labels import investor_type

#: Decisions and types of investors that a classification may have, states of checks, and the form of an id of evidence.
DECISIONS = ("QUALIFIED", "NOT_QUALIFIED", "INSUFFICIENT_EVIDENCE")
INVESTOR_TYPES = ("CASH_HOME_BUYER", "FIX_AND_FLIP", "BUY_AND_HOLD", "BRRRR", "COMMERCIAL_INVESTOR", "LAND_INVESTOR", "MULTIFAMILY_INVESTOR", "REAL_ESTATE_INVESTOR_OTHER", "NOT_DETERMINED")
CHECKED = ("FOUND", "NOT_FOUND")
EVIDENCE_ID = "^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
#: Fixed value: what is missing when a qualification has no evidence.
NO_EVIDENCE = "Verified evidence supporting qualification"
#: Names by which a company's fields, and the list of companies, go.
NAMES, SITES, SOURCES, PEOPLE = ("company_name", "companyName", "name"), ("official_website", "officialWebsite", "website"), ("evidence_url", "evidenceUrl", "source_url", "sourceUrl", "evidence"), ("contacts", "people")
LISTS = ("companies", "candidates", "results")
URL = r"""https?://[^\s<>)\]},"']+"""


def member(value: Column, name: str) -> Column:
    """A member of a variant object; null without it, and where it is JSON's null."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(found) != "VOID", found)


def kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def text(value: Column) -> Column:
    """The string of a variant; null if it is something else."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def items(value: Column) -> Column:
    return F.when(kind(value).startswith("ARRAY<"), F.try_variant_get(value, "$", "array<variant>"))


def unfenced(content: Column) -> Column:
    """The text without a fence of code around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), "^﻿", "")), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def _strict(name: str, value: Column) -> Column:
    """Why a list of strings is none."""
    bad = items(value).isNull() | F.exists(items(value), lambda x: kind(x) != "STRING")
    return F.when(value.isNull(), f"MISSING_REQUIRED_FIELD: {name}").when(bad, f"INVALID_SCHEMA: {name}")


def _reference(item: Column) -> Column:
    """A piece of evidence: an id, or an object with one and perhaps a reason; null if it is neither."""
    own = F.trim(F.coalesce(text(item), text(member(item, "evidenceId")), F.when(member(item, "evidenceId").isNull() | (kind(member(item, "evidenceId")) != "STRING"), text(member(item, "id")))))
    return F.when(own.rlike(EVIDENCE_ID), F.struct(own.alias("evidence_id"), F.coalesce(text(member(item, "reason")), F.lit("")).alias("reason")))


def _references(name: str, value: Column) -> tuple[Column, Column]:
    found = F.transform(items(value), _reference)
    bad = items(value).isNull() | F.exists(found, lambda x: x.isNull())
    return F.when(value.isNull(), f"MISSING_REQUIRED_FIELD: {name}").when(bad, f"INVALID_SCHEMA: {name}"), found


def _checked(value: Column) -> Column:
    return F.when(value.isNull(), "NOT_FOUND").otherwise(F.upper(F.trim(text(value))))


def classifications(rows: DataFrame, content: str = "content") -> DataFrame:
    """The rows with `result`, a struct of the classification, or `error`, its kind and the member at fault: one of both is null.

    A fence of code around the JSON, prose before and after it and an object around the classification are taken off. A null or blank text
    is EMPTY_RESPONSE. Of several faults the first counts, in the order of the members in the struct.
    """
    cleaned = F.col("_cleaned")
    inner = F.regexp_extract(cleaned, r"(?s)\{.*\}", 0)
    read = lambda x: F.when(kind(F.try_parse_json(x)) != "VOID", F.try_parse_json(x))
    df = rows.withColumn("_cleaned", unfenced(F.col(content))).withColumn("_read", F.coalesce(read(cleaned), read(F.nullif(inner, F.lit("")))))
    whole = F.col("_read")
    nested = [F.when(text(member(member(whole, x), "decision")).isNotNull(), member(whole, x)) for x in ("classification", "result")]
    df = df.withColumn("_value", F.when(text(member(whole, "decision")).isNotNull(), whole).otherwise(F.coalesce(*nested, whole)))
    v = F.col("_value")
    names = ("decision", "category", "investorType", "exclusionReason", "confidence", "reasons", "positiveEvidence", "negativeEvidence", "missingEvidence", "companySizeVerification", "locationStatus")
    df = df.withColumns({f"_{n}": member(v, n) for n in names})
    of = {n: F.col(f"_{n}") for n in names}
    investor, unknown = investor_type(text(of["investorType"]), INVESTOR_TYPES)
    number = F.when(kind(of["confidence"]).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(of["confidence"], "$", "double")).otherwise(F.trim(text(of["confidence"])).try_cast("double"))
    positive_error, positive = _references("positiveEvidence", of["positiveEvidence"])
    negative_error, negative = _references("negativeEvidence", of["negativeEvidence"])
    strings = lambda n: F.transform(items(of[n]), lambda x: text(x))
    size, place = _checked(of["companySizeVerification"]), _checked(of["locationStatus"])
    error = F.coalesce(
        F.when(cleaned == "", "EMPTY_RESPONSE").when(whole.isNull(), "INVALID_JSON").when(~kind(v).startswith("OBJECT<"), "INVALID_SCHEMA: classification"),
        F.when(of["decision"].isNull(), "MISSING_REQUIRED_FIELD: decision").when(~F.coalesce(text(of["decision"]).isin(*DECISIONS), F.lit(False)), "INVALID_ENUM: decision"),
        F.when(of["category"].isNull(), "MISSING_REQUIRED_FIELD: category").when(F.coalesce(text(of["category"]), F.lit("")) == "", "INVALID_SCHEMA: category"),
        F.when(of["investorType"].isNotNull() & (text(of["investorType"]).isNull() | unknown), "INVALID_ENUM: investorType"),
        F.when(of["exclusionReason"].isNotNull() & text(of["exclusionReason"]).isNull(), "INVALID_SCHEMA: exclusionReason"),
        F.when(of["confidence"].isNull(), "MISSING_REQUIRED_FIELD: confidence").when(~F.coalesce(number.between(0, 1), F.lit(False)), "INVALID_SCHEMA: confidence"),
        _strict("reasons", of["reasons"]), positive_error, negative_error, _strict("missingEvidence", of["missingEvidence"]),
        F.when(~F.coalesce(size.isin(*CHECKED), F.lit(False)), "INVALID_SCHEMA: companySizeVerification"), F.when(~F.coalesce(place.isin(*CHECKED), F.lit(False)), "INVALID_SCHEMA: locationStatus"),
    )
    result = F.struct(
        text(of["decision"]).alias("decision"), text(of["category"]).alias("category"), F.coalesce(investor, F.lit("NOT_DETERMINED")).alias("investor_type"), text(of["exclusionReason"]).alias("exclusion_reason"), number.alias("confidence"),
        strings("reasons").alias("reasons"), positive.alias("positive_evidence"), negative.alias("negative_evidence"), strings("missingEvidence").alias("missing_evidence"), size.alias("company_size_verification"), place.alias("location_status"),
    )
    out = df.withColumn("error", error)
    return out.withColumn("result", F.when(F.col("error").isNull(), result)).drop("_cleaned", "_read", "_value", *(f"_{n}" for n in names))


def backed(result: Column, known_ids: Column) -> Column:
    """A classification whose positive evidence is known; one that says QUALIFIED without any becomes INSUFFICIENT_EVIDENCE."""
    valid = F.filter(result["positive_evidence"], lambda e: F.array_contains(known_ids, e["evidence_id"]))
    bare = (result["decision"] == "QUALIFIED") & (F.size(valid) == 0)
    kept = result.withField("positive_evidence", valid)
    lacking = kept.withField("decision", F.lit("INSUFFICIENT_EVIDENCE")).withField("missing_evidence", F.concat(result["missing_evidence"], F.array(F.lit(NO_EVIDENCE)))).withField("exclusion_reason", F.lit(None).cast("string"))
    return F.when(bare, lacking).otherwise(kept)


def spans(content: Column) -> Column:
    """The closed bracketed parts of a text in the order in which they close: an array of structs of from, length and depth.

    Brackets inside strings are none. What a cut text leaves open has no part; what it had closed before has.
    """
    chunk = r"""(?s)[^"{}\[\]]*+(?:"(?:[^"\\]++|\\.)*+(?:"|\\?$)|[{}\[\]])"""
    none = "struct<at: int, open: array<int>, closed: array<struct<from: int, length: int, depth: int>>>"

    def step(state: Column, part: Column) -> Column:
        at = (state["at"] + F.length(part)).cast("int")
        last, quoted = F.substring(part, -1, 1), part.contains('"')
        top = F.try_element_at(state["open"], F.lit(-1))
        rest = F.slice(state["open"], F.lit(1), F.greatest(F.lit(0), F.size(state["open"]) - 1))
        opens, closes = ~quoted & last.isin("{", "["), ~quoted & last.isin("}", "]") & top.isNotNull()
        closed = F.struct(top.alias("from"), (at - top).cast("int").alias("length"), F.size(rest).alias("depth"))
        return F.struct(at.alias("at"), F.when(opens, F.concat(state["open"], F.array((at - 1).cast("int")))).when(closes, rest).otherwise(state["open"]).alias("open"), F.when(closes, F.concat(state["closed"], F.array(closed))).otherwise(state["closed"]).alias("closed"))

    start = F.from_json(F.lit('{"at": 0, "open": [], "closed": []}'), none)
    return F.aggregate(F.regexp_extract_all(content, F.lit(chunk), F.lit(0)), start, step, lambda s: s["closed"])


def _cut(content: Column) -> Callable[[Column], Column]:
    return lambda s: F.substr(content, s["from"] + 1, s["length"])


def _first(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(member(value, n) for n in names))


RECORD = "struct<company_name: string, official_website: string, evidence_url: string, contacts: array<struct<full_name: string, title: string, email: string>>>"


def _company(value: Column) -> Column:
    """A company of a JSON object; null without a name and addresses that are addresses."""
    name, site = text(_first(value, NAMES)), text(_first(value, SITES))
    source = text(F.coalesce(_first(value, SOURCES), _first(value, SITES)))
    people = F.transform(F.filter(items(_first(value, PEOPLE)), lambda p: text(member(p, "full_name")).isNotNull()), lambda p: F.struct(*(text(member(p, x)).alias(x) for x in ("full_name", "title", "email"))))
    listed = _first(value, PEOPLE).isNull() | items(_first(value, PEOPLE)).isNotNull()
    good = (F.trim(name) != "") & site.rlike(r"(?i)^https?://[^\s/?#]+") & source.rlike(r"(?i)^https?://[^\s/?#]+") & listed
    none = F.from_json(F.lit("[]"), "array<struct<full_name: string, title: string, email: string>>")
    return F.when(good, F.struct(F.trim(name).alias("company_name"), site.alias("official_website"), source.alias("evidence_url"), F.coalesce(people, none).alias("contacts")))


def _listed(value: Column) -> Column:
    """The array of companies that a JSON value is or has; null if it has none."""
    return F.coalesce(items(value), *(items(member(value, n)) for n in LISTS), F.when(kind(value).startswith("OBJECT<") & _first(value, NAMES).isNotNull(), F.array(value)))


def _bulleted(content: Column) -> Column:
    """Companies of lines: a name begins one, and the addresses and people of the lines after it are its own."""
    labels = r"official website|website|evidence(?: url)?|source(?: url)?|person(?: name)?|contact|full[_ ]?name|title|email|person title|person email"
    bullet = r"^(?:[-*•]|\d+[.)])\s*"
    none = "array<struct<name: string, urls: array<string>, full_name: string, title: string, email: string>>"
    said = lambda line, pattern: F.nullif(F.trim(F.regexp_extract(line, f"(?i){pattern}", 1)), F.lit(""))

    def step(known: Column, raw: Column) -> Column:
        line = F.trim(F.regexp_replace(raw, bullet, ""))
        named = said(line, r"^(?:company(?:\s+name)?|name)\s*:\s*(.+)$")
        leads = (F.size(known) == 0) & raw.rlike(r"^(?:[-*•]|\d+[.)])\s+") & ~line.rlike(rf"(?i)^(?:{labels})\s*:")
        name = F.nullif(F.trim(F.regexp_replace(F.coalesce(named, F.when(leads, line)), r"\s+\|\s+.*$", "")), F.lit(""))
        empty = F.lit(None).cast("string")
        began = F.when(name.isNotNull(), F.concat(known, F.array(F.struct(name.alias("name"), F.array().cast("array<string>").alias("urls"), *(empty.alias(x) for x in ("full_name", "title", "email")))))).otherwise(known)
        last = F.try_element_at(began, F.lit(-1))
        urls = F.transform(F.regexp_extract_all(line, F.lit(f"(?i){URL}"), F.lit(0)), lambda u: F.regexp_replace(u, "[.;]$", ""))
        grown = F.struct(
            last["name"].alias("name"), F.array_distinct(F.concat(last["urls"], urls)).alias("urls"), F.coalesce(said(line, r"^(?:person(?:\s+name)?|contact|full[_ ]?name)\s*:\s*(.+)$"), last["full_name"]).alias("full_name"),
            F.coalesce(said(line, r"^(?:title|person title)\s*:\s*(.+)$"), last["title"]).alias("title"), F.coalesce(said(line, r"^(?:email|person email)\s*:\s*([^\s,;]+)"), last["email"]).alias("email"),
        )
        return F.when(F.size(began) > 0, F.concat(F.slice(began, F.lit(1), F.size(began) - 1), F.array(grown))).otherwise(began)

    lines = F.filter(F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.filter(F.aggregate(lines, F.from_json(F.lit("[]"), none), step), lambda r: F.size(r["urls"]) > 0)
    people = lambda r: F.filter(F.array(F.struct(r["full_name"].alias("full_name"), r["title"].alias("title"), r["email"].alias("email"))), lambda p: F.coalesce(p["full_name"], p["title"], p["email"]).isNotNull())
    return F.transform(found, lambda r: F.struct(r["name"].alias("company_name"), F.get(r["urls"], F.lit(0)).alias("official_website"), F.coalesce(F.get(r["urls"], F.lit(1)), F.get(r["urls"], F.lit(0))).alias("evidence_url"), people(r).alias("contacts")))


def _told(content: Column) -> Column:
    """Companies that prose names by a link, a label or bold letters, with the first address of a link or paragraph that names them."""
    grab = lambda pattern, group: F.regexp_extract_all(content, F.lit(pattern), F.lit(group))
    links = F.arrays_zip(grab(r"(?i)\[([^\]]{2,160})\]\((https?://[^)\s]+)\)", 1).alias("label"), grab(r"(?i)\[([^\]]{2,160})\]\((https?://[^)\s]+)\)", 2).alias("url"))
    raw = F.concat(F.transform(links, lambda x: x["label"]), grab(r"(?im)^\s*(?:[-*]\s*)?(?:company(?:\s+name)?|business)\s*:\s*([^\n|;]+)", 1), grab(r"\*\*([^*\n]{3,120})\*\*", 1))
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*|^\[|\]$|^\*\*|\*\*$", ""), r"(?i)\s+(?:-\s*)?(?:official website|official site|home page|homepage|website|about us|contact us)\s*$|[|–—-]\s*$", ""))
    names = F.filter(F.transform(raw, tidy), lambda x: F.length(x).between(3, 120) & ~x.rlike(r"(?i)^(?:official website|website|home|homepage|about|contact|read more|learn more|source)$|^https?://"))
    names = F.filter(names, lambda x, i: F.array_position(F.transform(names, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    paragraphs = F.split(content, r"\n\s*\n")

    def one(name: Column) -> Column:
        holds = lambda where: F.contains(F.lower(where), F.lower(name))
        own = F.transform(F.filter(links, lambda x: holds(x["label"])), lambda x: x["url"])
        near = F.regexp_extract_all(F.array_join(F.filter(paragraphs, lambda p: holds(p)), "\n"), F.lit(f"(?i){URL}"), F.lit(0))
        url = F.regexp_replace(F.get(F.concat(own, near), F.lit(0)), "[.,;:!?]+$", "")
        return F.struct(name.alias("company_name"), url.alias("official_website"), url.alias("evidence_url"), F.from_json(F.lit("[]"), "array<struct<full_name: string, title: string, email: string>>").alias("contacts"))

    return F.filter(F.transform(names, one), lambda c: c["official_website"].isNotNull())


def company_lists(rows: DataFrame, content: str = "content") -> DataFrame:
    """The rows with `form` (json, partial, bullets, prose; null if nothing was found) and `companies`, an array of companies.

    JSON counts whole, in a fence or inside other text; of JSON that was cut off the objects that had been closed count;
    text that begins as JSON is nothing else. Companies without a name or address are left out. Null is an empty text.
    """
    df = rows.withColumn("_text", F.trim(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "^﻿", "")))
    body = F.col("_text")
    df = df.withColumn("_spans", spans(body))
    outer = F.transform(F.filter("_spans", lambda s: s["depth"] == 0), _cut(body))
    df = df.withColumn("_parsed", F.get(F.filter(F.transform(F.concat(F.array(body, unfenced(body)), outer), lambda c: _listed(F.try_parse_json(c))), lambda a: a.isNotNull()), F.lit(0)))
    objects = F.filter(F.transform(F.filter("_spans", lambda s: F.substr(body, s["from"] + 1, F.lit(1)) == "{"), _cut(body)), lambda o: o.rlike(r'"company_name"\s*:'))
    good = lambda array: F.filter(array, lambda c: c.isNotNull())
    partial = good(F.transform(objects, lambda o: F.when(text(member(F.try_parse_json(o), "company_name")).isNotNull(), _company(F.try_parse_json(o)))))
    df = df.withColumns({"_whole": good(F.transform("_parsed", _company)), "_partial": partial})
    is_json = body.rlike(r"^[{\[]")
    df = df.withColumns({"_bullets": F.when(~is_json, _bulleted(body)), "_prose": F.when(~is_json, _told(body))})
    forms = {"json": F.col("_parsed").isNotNull(), "partial": F.size("_partial") > 0, "bullets": F.size("_bullets") > 0, "prose": F.size("_prose") > 0}
    form = F.when(forms["json"], "json").when(forms["partial"], "partial").when(forms["bullets"], "bullets").when(forms["prose"], "prose")
    df = df.withColumn("form", form)
    picked = F.when(F.col("form") == "json", F.col("_whole")).when(F.col("form") == "partial", F.col("_partial")).when(F.col("form") == "bullets", F.col("_bullets")).when(F.col("form") == "prose", F.col("_prose"))
    return df.withColumn("companies", F.coalesce(picked, F.from_json(F.lit("[]"), f"array<{RECORD}>"))).drop("_text", "_spans", "_parsed", "_whole", "_partial", "_bullets", "_prose")
