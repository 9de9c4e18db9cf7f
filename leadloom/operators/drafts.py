"""Drafts of search plans that a model wrote, held against the prompt that they are for.

A draft is JSON text. Its shape is judged by the schema of its variant value; then every leaf is aligned with the prompt: it must stand
there, or a quote that the draft gives for it must stand there and name it. A draft with a leaf that the prompt does not
say, or without something that the prompt plainly says, is rejected as a whole, with the first reason, and the plan of
operators.prompts counts. All is one projection of the distinct pairs of prompt and draft.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.gazetteer import interpret, literal_map
from leadloom.operators.prompts import NEGATED, RESULT_CAP, SOCIALS, read_each, says
from leadloom.operators.relational import once_each

#: Fields that a draft may name, by the pattern of what names them in a quote.
FIELD_WORDS = {
    "companyWebsite": r"website|web site", "companyEmail": r"company(?:'s)?\s+e-?mail", "companyPhone": r"company(?:'s)?\s+phone", "companyLinkedin": "linkedin", "companyFacebook": "facebook", "companyInstagram": "instagram", "companyYoutube": "youtube",
    "companyX": r"company\s+(?:x|twitter)|x/twitter|twitter|x account", "employeeCount": "employee|staff|headcount|company size", "location": "location|address|city|state|country|region|postal code|zip", "industry": "industry|category",
    "personName": "name|ceo|founder|owner|president|manager|partner", "personTitle": "title|role|ceo|founder|owner|president|manager|partner",
    "personEmail": r"person(?:'s)?\s+e-?mail|decision[- ]maker(?:'s)?\s+e-?mail|contact e-?mail|verified\s+(?:person(?:'s)?\s+|decision[- ]makers?\s+)?e-?mails?", "personPhone": r"person(?:'s)?\s+phone|decision[- ]maker(?:'s)?\s+phone|contact phone",
    "personLinkedin": "linkedin", "personFacebook": "facebook", "personInstagram": "instagram", "personYoutube": "youtube", "personX": r"(?:their|person(?:'s)?)\s+(?:x|twitter)|x/twitter|twitter", "website": "website|web site", "email": "e-?mail", "phone": "phone",
    "name": r"\bname\b", "title": r"\btitle\b", "linkedin": "linkedin", "facebook": "facebook", "instagram": "instagram", "x": "x/twitter|twitter|x account", "youtube": "youtube",
}
#: Platforms, intents of counts, and fields by which a required field of the prompt may be met.
PLATFORM_NAMES = ("linkedin", "facebook", "instagram", "x", "youtube")
INTENTS = ("exact", "maximum", "minimum", "approximate")
MET_BY = {
    "website": ("website", "companyWebsite"), "email": ("email", "companyEmail", "personEmail"), "phone": ("phone", "companyPhone", "personPhone"), "linkedin": ("linkedin", "personLinkedin", "companyLinkedin"),
    "facebook": ("facebook", "personFacebook", "companyFacebook"), "instagram": ("instagram", "personInstagram", "companyInstagram"), "companyLinkedin": ("companyLinkedin", "linkedin"), "companyFacebook": ("companyFacebook", "facebook"),
    "companyInstagram": ("companyInstagram", "instagram"), "companyYoutube": ("companyYoutube", "youtube"), "companyX": ("companyX", "x", "twitter"), "personLinkedin": ("personLinkedin", "linkedin"), "personFacebook": ("personFacebook", "facebook"),
    "personInstagram": ("personInstagram", "instagram"), "personEmail": ("personEmail", "email"),
}
#: Roles by the pattern of all their spellings.
ROLES = {
    "CEO": r"^ceos?$|chief executive officer", "Co-Founder": "^co-?founders?$", "Founder": "^founders?$", "President": "^presidents?$", "Owner": "^owners?$", "Managing Director": "^managing directors?$", "Manager": "^managers?$", "Partner": "^partners?$",
}

LISTS = ("industry", "leadTypes", "decisionMakerRoles", "requiredFields", "preferredFields", "companyFields", "personFields", "socialPlatforms")
PLACE_PARTS = ("country", "state", "city", "region", "postalCode")
FLAGS = {"emailRequirement": ("requested", "required", "verified"), "websiteRequirement": ("requested", "required"), "verificationRequirement": ("requested", "required")}
SCHEMA = (
    "requestedCount int, countIntent string, targetType string, " + ", ".join(f"{x} array<string>" for x in LISTS) + ", locations array<struct<rawText string, country string, state string, city string, region string, postalCode string>>,"
    " employeeSize struct<min int, max int, exact int, qualitative string, sourceText string>, emailRequirement struct<requested boolean, required boolean, verified boolean>, websiteRequirement struct<requested boolean, required boolean>,"
    " verificationRequirement struct<requested boolean, required boolean, fields array<string>>, minimumScore int, unresolvedRequirements array<struct<text string, reason string, sourceText string>>,"
    " evidenceQuotes array<struct<field string, value string, quote string>>"
)


def _object(keys: str, kinds: str, names: tuple[str, ...]) -> str:
    return rf"OBJECT<(?:(?:{'|'.join(names)}): {kinds}(?:, )?)*{keys}>"


#: What the schema of each member's value must look like.
SHAPES = {
    "requestedCount": "BIGINT|VOID", "countIntent": "STRING|VOID", "targetType": "STRING", **{x: "ARRAY<(?:STRING|VOID)>" for x in LISTS}, "locations": f"ARRAY<(?:VOID|{_object('', '(?:STRING|VOID)', ('rawText', *PLACE_PARTS))})>",
    "employeeSize": f"VOID|{_object('', '(?:BIGINT|STRING|VOID)', ('min', 'max', 'exact', 'qualitative', 'sourceText'))}", "minimumScore": "BIGINT|VOID", "emailRequirement": _object("", "BOOLEAN", FLAGS["emailRequirement"]),
    "websiteRequirement": _object("", "BOOLEAN", FLAGS["websiteRequirement"]), "verificationRequirement": r"OBJECT<fields: ARRAY<(?:STRING|VOID)>, requested: BOOLEAN, required: BOOLEAN>",
    "unresolvedRequirements": f"ARRAY<(?:VOID|{_object('', 'STRING', ('text', 'reason', 'sourceText'))})>", "evidenceQuotes": f"ARRAY<(?:VOID|{_object('', 'STRING', ('field', 'value', 'quote'))})>",
}


def tidy(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@dataclass
class Said:
    """A prompt in the forms that leaves are held against, each worked out once a row."""

    text: Column
    tidy: Column
    tokens: Column


def holds(text: Column | Said, value: Column) -> Column:
    """Whether a text has a value in it, whatever their case and blanks."""
    return F.contains(text.tidy if isinstance(text, Said) else tidy(text), tidy(value))


def _joined(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: _singular(w)), " "), F.lit(" "))


def _singular(word: Column) -> Column:
    n = F.length(word)
    return F.when((n > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", "")).otherwise(word)


def _tokens(text: Column | Said) -> Column:
    """The words of a text in the singular, a blank around each."""
    return text.tokens if isinstance(text, Said) else _joined(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def _phrase(value: Column) -> Column:
    return _joined(F.filter(F.split(F.lower(F.replace(value, F.lit("_"), F.lit(" "))), r"\s+"), lambda w: w != ""))


def has_phrase(text: Column | Said, value: Column) -> Column:
    """Whether the words of a value follow each other in a text, singular and plural alike; no words stand nowhere."""
    return F.contains(_tokens(text), F.nullif(_phrase(value), F.lit("  ")))


def stands(text: Column | Said, value: Column) -> Column:
    return F.coalesce(has_phrase(text, value), F.lit(False)) | holds(text, F.replace(value, F.lit("_"), F.lit(" ")))


def term(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_"), "[^a-z0-9_]", "")


def with_spans(leaves: Column, prompt: Said) -> Column:
    """The leaves with from and to: where the words of the value, else those of its quote, stand in the prompt, in code points from 0."""
    blanks = lambda text: F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    upto = lambda n, rest: F.length(F.call_function("regexp_extract", F.lower(prompt.text), F.concat(F.lit("^(?:[^a-z0-9]*[a-z0-9]+){"), n.cast("string"), F.lit("}" + rest)), F.lit(0)))

    def one(leaf: Column) -> Column:
        there = F.coalesce(has_phrase(prompt, leaf["value"]), F.lit(False))
        phrase = _phrase(leaf["value"])
        first = blanks(F.call_function("substring_index", prompt.tokens, phrase, F.lit(1)))
        said = F.when(holds(prompt, leaf["value"]), tidy(leaf["value"])).otherwise(tidy(leaf["quote"]))
        at = F.nullif(F.position(said, prompt.tidy), F.lit(0)) - 1
        begins = F.when(there, upto(first, "[^a-z0-9]*")).otherwise(at)
        ends = F.when(there, upto(first + blanks(phrase) - 1, "")).otherwise(at + F.length(said))
        return F.struct(leaf["field"].alias("field"), leaf["value"].alias("value"), begins.cast("int").alias("from"), ends.cast("int").alias("to"), leaf["error"].alias("error"))

    return F.transform(leaves, one)


def says_role(said: Column | Said, role: Column) -> Column:
    low, text = F.lower(role), said.text if isinstance(said, Said) else said
    return (
        F.coalesce(has_phrase(said, role), F.lit(False)) | ((low == "ceo") & says(text, r"chief executive officer|\bceos?\b")) | (low.rlike("^co-?founders?$") & says(text, "co-?founders?")) | (low.rlike("^founders?$") & says(text, r"co-?founders?|\bfounders?\b"))
        | (low.rlike("^owners?$") & says(text, r"\bowners?\b")) | (low.rlike("^managers?$") & says(text, r"\bmanagers?\b")) | (low.rlike("^partners?$") & says(text, r"\bpartners?\b"))
    )


def canonical_role(role: Column) -> Column:
    low, out = F.replace(F.lower(F.trim(role)), F.lit("_"), F.lit(" ")), None
    for name, pattern in ROLES.items():
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(F.array_join(F.transform(F.split(F.trim(role), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "))


def _field_pattern(field: Column) -> Column:
    known = literal_map({k.lower(): f"(?i){v}" for k, v in FIELD_WORDS.items()})
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(field), "[^a-z0-9]", "")), F.lit("(?!)"))


def names_field(text: Column, field: Column) -> Column:
    return F.rlike(text, _field_pattern(field))


def covers(actual: Column, expected: Column) -> Column:
    spaced = lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    real, invests = says(actual, "real[ _-]?estate"), says(actual, "invest|acquisition|buyer")
    return (term(actual) == term(expected)) | has_phrase(spaced(actual), expected) | has_phrase(spaced(expected), actual) | ((expected == "real_estate") & real) | ((expected == "real_estate_investor") & real & invests)


def _count_said(text: Column, count: Column) -> Column:
    nouns = "companies|company|leads|lead|agencies|agency|firms|firm|businesses|business|restaurants|restaurant"
    verbs = r"find|get|show|need|want|search(?:\s+for)?|looking\s+for|up to|at least|maximum(?: of)?|max|around|about|approximately|approx"
    return F.rlike(text, F.concat(F.lit(rf"(?i)\b(?:{verbs})\s+"), count, F.lit(r"\b|\b"), count, F.lit(rf"\s+(?:{nouns})\b")))


def _word(text: Column, number: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(r"\b"), number.cast("string"), F.lit(r"\b")))


def _leaf(field: str, value: Column, grounded: Column, quote: Column, why: str) -> Column:
    """A leaf of a draft with the quote given for it, and why it is refused."""
    return F.struct(F.lit(field).alias("field"), value.alias("value"), quote.alias("quote"), F.when(~F.coalesce(grounded, F.lit(False)), F.concat(F.lit(f"{why}: "), value)).alias("error"))


def leaves(prompt: Said, d: Column, plan: Column) -> Column:
    """Every leaf of a parsed draft that must be grounded in the prompt, as an array of structs in the order in which they are judged."""
    quotes = d["evidenceQuotes"]
    first = lambda found: F.coalesce(F.get(found, F.lit(0))["quote"], F.lit(""))
    exact = lambda field, value: first(F.filter(quotes, lambda q: (q["field"] == field) & (F.lower(q["value"]) == F.lower(value))))
    loose = lambda fields, value: first(F.filter(quotes, lambda q: q["field"].isin(*fields) & ((F.lower(q["value"]) == F.lower(value)) | holds(q["value"], value) | holds(value, q["value"]) | holds(q["quote"], F.replace(value, F.lit("_"), F.lit(" "))))))

    def quoted(quote: Column, supports: Column) -> Column:
        return (quote != "") & holds(prompt, quote) & supports

    def each(array: Column, one: Callable[[Column], Column]) -> Column:
        return F.transform(array, one)

    def industry(v: Column) -> Column:
        q = exact("industry", v)
        return _leaf("industry", v, stands(prompt, v) | quoted(q, has_phrase(q, v)), q, "ungrounded industry")

    def lead_type(v: Column) -> Column:
        q = F.coalesce(F.nullif(exact("leadTypes", v), F.lit("")), loose(("leadTypes",), v))
        said, invests = F.coalesce(F.nullif(q, F.lit("")), prompt.text), says(v, "real[ _-]?estate.*investor|investor.*real[ _-]?estate")
        meant = invests & says(said, "real[ -]?estate|property") & says(said, "invest(?:or|ment)|acquisition|buyer")
        return _leaf("leadTypes", v, (stands(prompt, v) | quoted(q, has_phrase(said, v) | meant)) & (~invests | says(prompt.text, "real[ -]?estate|property")), q, "ungrounded lead type")

    def place(p: Column) -> Column:
        raw, known, q = p["rawText"], interpret(p["rawText"]), loose(("locations", "location"), p["rawText"])
        expected = F.exists(plan["locations"], lambda e: F.exists(F.filter(F.array(e["original"], e["city"], e["state"], e["region"], e["country"]), lambda t: F.coalesce(t, F.lit("")) != ""), lambda t: holds(raw, t) | holds(t, raw)))
        there = (F.trim(raw) != "") & holds(prompt, raw) & (expected | quoted(q, holds(q, raw) | holds(raw, q)))
        for part in PLACE_PARTS:
            value = p[part]
            fits = holds(raw, value)
            if part != "postalCode":
                fits = fits | ((known[part] != "") & (holds(known[part], value) | (term(known[part]) == term(value))))
            if part in ("country", "state"):
                fits = fits | ((known[part] != "") & (term(interpret(value)[part]) == term(known[part])))
            there = there & (F.coalesce(value == "", F.lit(True)) | F.coalesce(fits, F.lit(False)))
        return _leaf("locations", raw, there, q, "unsupported location")

    def role(v: Column) -> Column:
        q = exact("decisionMakerRoles", v)
        return _leaf("decisionMakerRoles", v, says_role(prompt, v) | stands(prompt, v) | quoted(q, says_role(q, v)), q, "ungrounded role")

    def field(v: Column) -> Column:
        q = exact("fields", v)
        return _leaf("fields", v, v.isin(*FIELD_WORDS) & quoted(q, names_field(q, v)), q, "ungrounded field")

    def platform(v: Column) -> Column:
        q = exact("socialPlatforms", v)
        return _leaf("socialPlatforms", v, v.isin(*PLATFORM_NAMES) & quoted(q, names_field(q, v) | says(q, SOCIALS)), q, "ungrounded platform")

    def open_item(u: Column) -> Column:
        return _leaf("unresolvedRequirements", u["text"], holds(prompt, u["sourceText"]) & holds(u["sourceText"], u["text"]), u["sourceText"], "unquoted open requirement")

    size = d["employeeSize"]
    bound = lambda name: F.when(size[name].isNotNull(), _leaf(f"employeeSize.{name}", size[name].cast("string"), (size[name] >= 0) & holds(prompt, size["sourceText"]) & _word(size["sourceText"], size[name]) & says(size["sourceText"], r"employee|company\s+size|staff|headcount"), size["sourceText"], "invented size bound"))
    number, score = d["requestedCount"].cast("string"), d["minimumScore"].cast("string")
    counted, scored = exact("requestedCount", number), exact("minimumScore", score)
    lone = F.array(
        F.when(d["requestedCount"].isNotNull(), _leaf("requestedCount", number, (d["requestedCount"] == plan["requested_count"]) | (plan["requested_count"].isNull() & quoted(counted, _count_said(counted, number) | (_word(counted, number) & _count_said(prompt.text, number)))), counted, "ungrounded count")),
        bound("min"), bound("max"), bound("exact"),
        F.when(size["qualitative"].isNotNull(), _leaf("employeeSize.qualitative", size["qualitative"], holds(prompt, size["sourceText"]) & holds(size["sourceText"], size["qualitative"]), size["sourceText"], "unsupported qualitative size")),
        F.when(d["minimumScore"].isNotNull(), _leaf("minimumScore", score, d["minimumScore"].between(0, 100) & quoted(scored, says(scored, "score") & _word(scored, score)), scored, "ungrounded score")),
    )
    fields = F.concat(d["requiredFields"], d["preferredFields"], d["companyFields"], d["personFields"])
    return F.concat(
        F.filter(lone, lambda x: x.isNotNull()), each(d["industry"], industry), each(d["leadTypes"], lead_type), each(d["locations"], place), each(d["decisionMakerRoles"], role), each(fields, field), each(d["socialPlatforms"], platform),
        each(d["unresolvedRequirements"], open_item),
    )


def _shape_error(draft: Column, kinds: Column, d: Column) -> Column:
    """Why a draft is no draft at all; null if it is one. `kinds` maps members to the schemas of their values."""
    keys = F.json_object_keys(draft)
    out = F.when(keys.isNull(), "not an object").when(F.size(F.array_except(keys, F.array(*map(F.lit, SHAPES)))) > 0, "unknown members")
    for name, shape in SHAPES.items():
        kind = F.try_element_at(kinds, F.lit(name))
        optional = "VOID" in shape.split("|")
        out = out.when(~F.coalesce(kind, F.lit("VOID")).rlike(f"^(?:{shape})$") if optional else kind.isNull() | ~kind.rlike(f"^(?:{shape})$"), f"malformed {name}")
    for name in LISTS:
        out = out.when(F.exists(d[name], lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""), f"malformed {name}")
    out = out.when(~d["targetType"].isin("COMPANIES", "QUALIFIED_LEADS"), "malformed targetType").when(d["countIntent"].isNotNull() & ~d["countIntent"].isin(*INTENTS), "malformed countIntent").when(d["requestedCount"] < 1, "malformed requestedCount")
    return out.when(F.exists(d["locations"], lambda p: F.trim(F.coalesce(p["rawText"], F.lit(""))) == ""), "malformed locations").when(d["employeeSize"].isNotNull() & d["employeeSize"]["exact"].isNotNull() & (d["employeeSize"]["min"].isNotNull() | d["employeeSize"]["max"].isNotNull()), "exact size mixed with a range")


def _flag_error(prompt: Column, d: Column) -> Column:
    """Why the flags of a draft ask for more than the prompt does."""
    mail, site, check = d["emailRequirement"], d["websiteRequirement"], d["verificationRequirement"]
    negated = says(prompt, NEGATED)
    return (
        F.when((d["targetType"] == "QUALIFIED_LEADS") & ~says(prompt, r"\bqualified\s+leads?\b"), "invented target")
        .when(mail["requested"] & ~says(prompt, r"\be-?mails?\b"), "invented email requirement")
        .when(mail["verified"] & ~says(prompt, r"verified\s+(?:decision[- ]makers?\s+|person(?:'s)?\s+)?e-?mails?|e-?mails?\s+(?:must be\s+)?verified"), "invented email verification")
        .when(mail["required"] & ~mail["requested"], "email required but not requested")
        .when(mail["required"] & ~mail["verified"] & ~says(prompt, r"\b(?:must|required|need|only)\b[^.]{0,60}\be-?mails?\b"), "plain email made mandatory")
        .when(site["requested"] & ~says(prompt, "website"), "invented website requirement")
        .when(site["required"] & ~site["requested"], "website required but not requested")
        .when(site["required"] & ~says(prompt, r"\b(?:must|required|need|only|with|including|and)\b[^.]{0,120}\b(?:company\s+)?website\b"), "plain website made mandatory")
        .when(check["requested"] & ~says(prompt, r"\bverified\b|\bverification\b"), "invented verification")
        .when((check["requested"] | mail["verified"]) & negated, "verification despite a negation")
        .when(check["required"] & ~check["requested"], "verification required but not requested")
        .when(F.exists(check["fields"], lambda f: ~names_field(prompt, f)), "verification of an unrequested field")
    )


def _omission(d: Column, plan: Column) -> Column:
    """What the prompt plainly says and the draft does not."""
    expected, actual = plan["company_size"], d["employeeSize"]
    missing = lambda array, there: F.exists(array, lambda e: ~F.coalesce(there(e), F.lit(False)))
    parts = lambda e: F.filter(F.array(e["original"], e["city"], e["state"], e["region"], e["country"]), lambda t: F.coalesce(t, F.lit("")) != "")
    named = F.concat(d["requiredFields"], d["preferredFields"], d["companyFields"], d["personFields"])
    met = literal_map({k: ",".join(v) for k, v in MET_BY.items()})
    differs = lambda name: expected[name].isNotNull() & ~F.coalesce(actual[name] == expected[name], F.lit(False))
    size = expected.isNotNull() & (actual.isNull() | differs("exact") | differs("min") | differs("max"))
    return (
        F.when(plan["count_intent"].isNotNull() & ~F.coalesce(d["countIntent"] == plan["count_intent"], F.lit(False)), "changed count intent")
        .when(plan["requested_count"].isNotNull() & ~F.coalesce(d["requestedCount"] == plan["requested_count"], F.lit(False)), "changed count")
        .when((plan["target_type"] == "QUALIFIED_LEADS") & (d["targetType"] != "QUALIFIED_LEADS"), "dropped target")
        .when((F.size(d["industry"]) > 0) & missing(plan["industry"], lambda e: F.exists(d["industry"], lambda a: covers(a, e))), "omitted industry")
        .when((F.size(d["leadTypes"]) > 0) & missing(plan["lead_types"], lambda e: F.exists(d["leadTypes"], lambda a: covers(a, e))), "omitted lead type")
        .when(missing(plan["locations"], lambda e: F.exists(d["locations"], lambda a: F.exists(parts(e), lambda t: holds(a["rawText"], t)))), "omitted location")
        .when(size, "omitted or changed size")
        .when(plan["qualitative_size"].isNotNull() & ~F.coalesce(F.lower(actual["qualitative"]) == plan["qualitative_size"], F.lit(False)), "omitted qualitative size")
        .when(missing(plan["roles"], lambda e: F.exists(d["decisionMakerRoles"], lambda a: says_role(a, e))), "omitted role")
        .when(missing(plan["social_platforms"], lambda e: F.array_contains(d["socialPlatforms"], e)), "omitted platform")
        .when(missing(plan["required_fields"], lambda e: F.arrays_overlap(named, F.split(F.coalesce(F.try_element_at(met, e), e), ","))), "omitted field")
        .when(plan["email"]["verified"] & ~d["emailRequirement"]["verified"], "omitted email verification")
        .when(plan["email"]["required"] & ~d["emailRequirement"]["required"], "omitted required email")
        .when(plan["website"]["required"] & ~d["websiteRequirement"]["required"], "omitted required website")
        .when(plan["minimum_score"].isNotNull() & ~F.coalesce(d["minimumScore"] == plan["minimum_score"], F.lit(False)), "omitted score")
    )


def judge(rows: DataFrame, prompt: str = "prompt", draft: str = "draft") -> DataFrame:
    """The rows with `plan` (of the prompt alone), `leaves` (of the draft, aligned), `error` and `method`.

    method is ai for a draft that stands, else deterministic_fallback, with the first error: of the shape, of a leaf, of a
    flag, of something left out. A null draft, or text that is no JSON, is no object. Texts are compared without regard
    to case and blanks. Columns of these names are replaced. Write the result, or a projection of it, before rows are
    picked by it: a filter would be pushed into the rules and have them worked out over again.
    """
    return once_each(rows, [prompt, draft], lambda pairs: _judge_each(pairs, "_once0", "_once1"))


def decide(rows: DataFrame, prompt: str = "prompt", draft: str = "draft") -> DataFrame:
    """The rows judged and with `final`, as merged(judge()) gives them, each distinct pair of prompt and draft once."""
    return once_each(rows, [prompt, draft], lambda pairs: merged(_judge_each(pairs, "_once0", "_once1"), "_once1"))


def _judge_each(rows: DataFrame, prompt: str, draft: str) -> DataFrame:
    df = read_each(rows, prompt, "plan").withColumns({"_draft": F.from_json(F.col(draft), SCHEMA), "_variant": F.try_parse_json(F.col(draft))})
    kinds = F.create_map(*(x for name in SHAPES for x in (F.lit(name), F.schema_of_variant(F.try_variant_get("_variant", f"$.{name}", "variant")))))
    df = df.withColumn("_kinds", kinds).withColumn("_shape", F.when(F.col("_variant").isNull(), "not an object").otherwise(_shape_error(F.col(draft), F.col("_kinds"), F.col("_draft"))))
    text, d, plan = F.col("plan")["original_prompt"], F.col("_draft"), F.col("plan")
    df = df.withColumns({"_tidy": tidy(text), "_tokens": _tokens(text)})
    said = Said(text, F.col("_tidy"), F.col("_tokens"))
    df = df.withColumn("_leaves", F.when(F.col("_shape").isNull(), leaves(said, d, plan))).withColumn("leaves", with_spans(F.col("_leaves"), said))
    refused = F.get(F.filter("leaves", lambda x: x["error"].isNotNull()), F.lit(0))["error"]
    df = df.withColumn("error", F.coalesce(F.col("_shape"), refused, _flag_error(text, d), _omission(d, plan)))
    return df.withColumn("method", F.when(F.col("error").isNull(), "ai").otherwise("deterministic_fallback")).drop("_variant", "_kinds", "_shape", "_draft", "_tidy", "_tokens", "_leaves")


def merged(judged: DataFrame, draft: str = "draft") -> DataFrame:
    """The judged rows with `final`: of a draft that stands its values and those of the prompt's plan, else the plan's."""
    d, plan, ai = F.from_json(F.col(draft), SCHEMA), F.col("plan"), F.col("method") == "ai"

    def kinds(own: Column, known: Column) -> Column:
        match = lambda v: F.get(F.filter(known, lambda e: covers(v, e)), F.lit(0))
        return F.array_distinct(F.when(F.size(own) > 0, F.transform(own, lambda v: term(F.coalesce(match(v), v)))).otherwise(F.transform(known, lambda v: term(v))))

    def place(p: Column) -> Column:
        known = interpret(p["rawText"])
        parts = {x: F.coalesce(F.nullif(known[x], F.lit("")), F.nullif(p[x], F.lit(""))) for x in ("country", "state", "city", "region")}
        return F.struct(*(v.alias(k) for k, v in (parts | {"country": F.coalesce(parts["country"], F.lit(""))}).items()), p["rawText"].alias("original"))

    both = lambda own, known: F.array_distinct(F.concat(own, known))
    size = F.coalesce(F.when(d["employeeSize"]["exact"].isNotNull(), F.struct(*(d["employeeSize"]["exact"].alias(x) for x in ("min", "max", "exact")))).when(F.coalesce(d["employeeSize"]["min"], d["employeeSize"]["max"]).isNotNull(), F.struct(*(d["employeeSize"][x].alias(x) for x in ("min", "max", "exact")))), plan["company_size"])
    required = both(d["requiredFields"], plan["required_fields"])
    count = F.coalesce(d["requestedCount"], plan["requested_count"])
    drawn = {
        "target_type": d["targetType"], "industry": kinds(d["industry"], plan["industry"]), "lead_types": kinds(d["leadTypes"], plan["lead_types"]), "locations": F.when(F.size(d["locations"]) > 0, F.transform(d["locations"], place)).otherwise(plan["locations"]),
        "company_size": size, "roles": F.array_distinct(F.transform(F.concat(d["decisionMakerRoles"], plan["roles"]), lambda r: canonical_role(r))), "required_fields": required,
        "preferred_fields": F.array_except(both(d["preferredFields"], F.when(F.size(plan["preferred_fields"]) > 0, plan["preferred_fields"]).otherwise(plan["optional_fields"])), required), "company_fields": both(d["companyFields"], plan["company_fields"]),
        "person_fields": both(d["personFields"], plan["person_fields"]), "social_platforms": both(d["socialPlatforms"], plan["social_platforms"]), "minimum_score": d["minimumScore"], "requested_count": count,
        "max_results": F.when(count.isNotNull(), F.least(F.lit(RESULT_CAP), count)), "count_intent": F.coalesce(d["countIntent"], plan["count_intent"], F.when(count.isNotNull(), "exact")),
    }
    return judged.withColumn("final", F.struct(*(F.when(ai, v).otherwise(plan[k]).alias(k) for k, v in drawn.items())))
