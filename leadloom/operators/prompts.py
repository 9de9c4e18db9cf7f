"""What prompts ask for: a cascade of rules as columns.

Every rule takes the words it understood out of the text before the next one looks: sizes first, then what is not
wanted, the count, the places; what then is left names the kind of company. All of it is column expressions; they
cost about a millisecond a text, so every distinct text is read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.gazetteer import interpret
from leadloom.operators.relational import once_each

#: Fixed value: results at most.
RESULT_CAP = 1000
#: Phrases of lead types, and the industry that they imply.
LEAD_PHRASES = {
    "commercial_real_estate_investor": (r"\bcommercial real estate investors?\b",), "land_investor": (r"\bland investors?\b",), "cash_home_buyer": (r"\bcash home buyers?\b",), "house_flipper": (r"\bhouse flippers?\b",),
    "fix_and_flip": (r"\bfix(?:(?:\s|-)?and(?:\s|-)?|\s*&\s*)flip\b",), "buy_and_hold": (r"\bbuy(?:\s|-)?and(?:\s|-)?hold\b",), "brrrr": (r"\bbrrrr?\b",), "wholesaler": (r"\b(?:real\s+estate\s+)?wholesalers?\b",),
    "real_estate_investor": (r"\bproperty investors?\b", r"\breal estate investors?\b", r"\breal estate investment(?:\s+compan(?:y|ies)|\s+firms?)?\b"),
}
LEAD_INDUSTRY = "real_estate"
#: Decision makers by the word that asks for them.
TITLES = {"ceo": "CEO", "founder": "Founder", "co-founder": "Co-Founder", "president": "President", "owner": "Owner", "managing director": "Managing Director", "manager": "Manager", "partner": "Partner"}
#: Fields of companies and of contacts that a prompt names, and words that say nothing of a company's kind.
COMPANY_FIELDS = ("website", "linkedin", "facebook", "instagram")
CONTACT_FIELDS = ("email", "phone", "linkedin", "facebook", "instagram")
VAGUE = ("excellent", "strong", "good", "best", "top", "great", "reputable", "reputation", "reputations", "quality", "leading", "premier", "successful", "small", "medium", "large", "preferably", "qualified")
#: Platforms and how they are written where a list of them or one after a cue is meant.
PLATFORMS = {"linkedin": "linkedin", "facebook": "facebook", "instagram": "instagram", "youtube": "youtube", "x": "twitter|x"}
#: Whose a field is, and wishes that are no requirements.
PERSON_CUE = r"(?:their|person(?:'s)?|decision[- ]maker(?:'s)?|ceo(?:'s)?|founder(?:'s)?|contact(?:'s)?)"
SOFT = r"\b(?:prefer(?:ably)?|ideally|if available|nice to have|where possible)\b"
SOCIALS = r"\b(?:company\s+)?social\s+(?:profiles?|media|accounts?)\b|\bsocials\b"
#: What bounds a count, by what it means for it.
COUNT_WORDS = {"exact": "exactly", "maximum": "up to|maximum of|maximum|max|limit of|limit", "minimum": "at least|minimum of|minimum|min", "approximate": "around|about|approximately|approx"}
#: Where a list of places ends.
PLACE_ENDS = r"that|who|which|with|without|preferably|excluding|exclude"
CRITERIA_BEGIN = (
    r",\s*(?:CEO|CFOs?|CTOs?|COOs?|Founders?|Presidents?|Owners?|Managing\s+Directors?|company\s+(?:LinkedIn|Facebook|Instagram|YouTube|Twitter|X)|person\s+LinkedIn|verified|websites?|e-?mails?|phones?|minimum\s+score|min\s+score"
    r"|decision[- ]makers?|social\s+profiles?)\b"
)
CRITERIA_GO_ON = r"\s+and\s+(?:CEO|Founders?|Presidents?|Owners?|company\s+(?:LinkedIn|Facebook|Instagram)|person\s+LinkedIn|verified|websites?|e-?mails?|LinkedIn|Facebook|Instagram|minimum\s+score)\b"
#: A verification that is mentioned in order not to have it.
NEGATED = (
    r"\b(?:do\s+not|don't|dont|need\s+not|no\s+need(?:\s+to)?|without|not)\b[^.]{0,48}\b(?:verified|verification)\b"
    r"|\b(?:verified|verification)\b[^.]{0,48}\b(?:not\s+(?:required|needed|necessary)|is\s+not\s+(?:required|needed)|optional|unnecessary|disabled)\b"
)
#: Fields of persons by what asks for them.
PERSON_FIELDS = {
    "name": r"\b(?:person|decision[- ]maker|contact)(?:'s)?\s+(?:full\s+)?name\b|\b(?:find|identify)\s+(?:the\s+)?(?:ceo|founder|owner|president|manager)\b",
    "email": r"\b(?:person|decision[- ]maker|contact)(?:'s)?\s+(?:business\s+)?e-?mails?\b|\b(?:verified\s+)?(?:decision[- ]maker|person)(?:'s)?\s+e-?mails?\b|\btheir\s+e-?mails?\b|\bpublic contact information\b|\bcontact details\b",
    "phone": r"\b(?:person|decision[- ]maker|contact)(?:'s)?\s+phone\b|\bpublic contact information\b|\bcontact details\b",
    "linkedin": rf"\b{PERSON_CUE}\s+linkedin\b|\bpersonlinkedin\b", "facebook": rf"\b{PERSON_CUE}\s+facebook\b", "instagram": rf"\b{PERSON_CUE}\s+instagram\b", "x": rf"\b{PERSON_CUE}\s+(?:x|twitter)\b", "youtube": rf"\b{PERSON_CUE}\s+youtube\b",
}


def says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def without(text: Column, *patterns: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, f"(?i){pattern}", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null without one."""
    return F.get(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(group)), F.lit(0))


def those(**conditions: Column) -> Column:
    """The names, in this order, whose condition holds."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())), lambda x: x.isNotNull())


def _size(text: Column) -> Column:
    """min, max and exact of a stated number of employees."""
    span = r"\b(?:company\s+size\s+)?(\d+)\s*(?:to|-|–)\s*(\d+)(?:\s*employees?)?\b"
    low, high = found(text, span, 1).try_cast("int"), found(text, span, 2).try_cast("int")
    exact, least = found(text, r"\b(?:with\s+)?(\d+)\s+employees?\b", 1).try_cast("int"), found(text, r"\b(\d+)\s*\+\s*employees?\b", 1).try_cast("int")
    size = lambda a, b, c: F.struct(a.alias("min"), b.alias("max"), c.alias("exact"))
    none = F.lit(None).cast("int")
    return F.when(says(text, r"\bemployees?\b|\bcompany\s+size\b") & (high >= low), size(low, high, none)).when(exact.isNotNull(), size(exact, exact, exact)).when(least.isNotNull(), size(least, none, none))


def _count(text: Column) -> Column:
    """requested and intent of the first count above 0."""
    number = r"(?!0+\b)(\d{1,5})\b"
    noun = "companies|company|leads|lead|agencies|agency|firms|firm|businesses|business|restaurants|restaurant"
    rules = [(intent, rf"\b(?:{words})\s+{number}") for intent, words in COUNT_WORDS.items()]
    rules += [("exact", rf"\b(?:find|get|show|need|want|search(?:\s+for)?|looking\s+for)\s+(?:exactly\s+)?{number}"), ("exact", rf"\b{number}\s+(?:{noun})\b")]
    hits = F.array(*(F.when(found(text, p, 1).isNotNull(), F.struct(F.regexp_instr(text, F.lit(f"(?i){p}")).alias("at"), found(text, p, 1).cast("int").alias("requested"), F.lit(intent).alias("intent"))) for intent, p in rules))
    return F.array_min(F.filter(hits, lambda h: h.isNotNull()))


def _without_count(text: Column, count: Column) -> Column:
    """The text without bounded counts, and without the first mention of the count, which is null where none is."""
    bounded = F.regexp_replace(text, rf"(?i)\b(?:{'|'.join(COUNT_WORDS.values())})\s+\d{{1,5}}\b", " ")
    once = F.regexp_replace(bounded, F.concat(F.lit(r"^(.*?)\b"), count.cast("string"), F.lit(r"\b")), F.lit("$1 "))
    return F.when(count.isNull(), text).otherwise(F.trim(F.regexp_replace(once, r"\s+", " ")))


def _places(marked: Column) -> Column:
    """Up to three places behind the last preposition, with the text of those whose country nobody knows."""
    text = F.trim(F.regexp_extract(marked, rf"(?i)^.*\x01(?:in|near|within)\s+(.+?)(?=\s+(?:{PLACE_ENDS})\b|$)", 1))
    ended = F.when(says(text, CRITERIA_BEGIN), F.regexp_replace(text, f"(?i){CRITERIA_BEGIN}.*$", "")).when(says(text, CRITERIA_GO_ON), F.regexp_replace(text, f"(?i){CRITERIA_GO_ON}.*$", "")).otherwise(text)
    ended = F.trim(F.regexp_replace(ended, r"[,\s]+$", ""))

    def one(part: Column) -> Column:
        place = interpret(part)
        return F.struct(*(place[x].alias(x) for x in ("country", "state", "city", "region")), F.when(place["country"] == "", part).alias("original"))

    filled = lambda p: F.coalesce(F.nullif(p["country"], F.lit("")), F.nullif(p["state"], F.lit("")), F.nullif(p["city"], F.lit("")), F.nullif(p["region"], F.lit(""))).isNotNull()
    return F.when(ended != "", F.slice(F.filter(F.transform(F.split(ended, r"(?i)\s+and\s+"), one), filled), 1, 3))


def _slug(words: Column) -> Column:
    last = F.try_element_at(words, F.lit(-1))
    plural = (F.length(last) > 4) & last.endswith("s") & ~last.endswith("ss")
    singular = F.when(~plural, last).when(last.endswith("ies"), F.regexp_replace(last, "ies$", "y")).otherwise(F.regexp_replace(last, "s$", ""))
    joined = F.concat_ws("_", F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), singular)
    return F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9_]+", ""), "^_+|_+$", "")


def _industry(left: Column, leads: Column) -> Column:
    """What is left names the industry unless lead phrases or real estate do."""
    subject = F.regexp_replace(left, r"(?i)^(?:please\s+)?(?:find|get|show(?:\s+me)?|search(?:\s+for)?|looking\s+for|i\s+need|we\s+need|need)\s+", "")
    subject = F.regexp_replace(subject, r"^\d+\s+", "")
    subject = without(subject, r"\b(?:companies|company|agencies|agency|firms|firm|businesses|business|leads|lead)\b", r"\b(?:that|who|which|are|is|their|with|plus|need|identify|the|a|an|or)\b")
    subject = F.regexp_replace(subject, r"[?.!]+$", "")
    subject = without(subject, *(p for some in LEAD_PHRASES.values() for p in some), *(rf"\b{title}s?\b" for title in TITLES), r"\b(?:website|websites|email|e-mails?|phone|linkedin|facebook|instagram|youtube|twitter|socials?|contact|details|public|information|profile|profiles)\b")
    words = F.filter(F.split(F.lower(subject), r"\s+"), lambda w: (w != "") & ~w.isin(*VAGUE, "and"))
    slug = F.when(F.size(words).between(1, 6) & (F.length(_slug(words)) >= 2), _slug(words))
    return F.when((F.size(leads) > 0) | says(subject, r"\breal estate\b"), F.array(F.lit(LEAD_INDUSTRY))).when(slug.isNotNull(), F.array(slug)).otherwise(F.array().cast("array<string>"))


def _asked_of_company(text: Column, platform: str) -> Column:
    any_ = "|".join(PLATFORMS.values())
    return says(text, rf"\bcompany\s+(?:(?:{any_})[\s,/&]+(?:and\s+)?)*(?:{PLATFORMS[platform]})\b")


def _asked_of_person(text: Column, platform: str) -> Column:
    return says(text, rf"\b{PERSON_CUE}\s+(?:{PLATFORMS[platform]})\b|\bperson{platform}\b")


def _in_clause_of_company(platform: str) -> Callable[[Column], Column]:
    """A platform in a demanding clause is the company's unless a person is named before it."""
    bare = rf"(?<!\b{PERSON_CUE}\s{{0,3}})\b(?:{PLATFORMS[platform]})\b"
    return lambda c: _asked_of_company(c, platform) | says(c, SOCIALS) | says(c, bare)


def _in_clause_of_person(platform: str) -> Callable[[Column], Column]:
    return lambda c: _asked_of_person(c, platform) | says(c, rf"\b{PERSON_CUE}\s*\b(?:{PLATFORMS[platform]})\b")


def _required(text: Column, mentioned: dict[str, Column]) -> Column:
    """The fields that must be there: by words nearby, and by the clauses behind words that demand."""
    near = r"only|must|require[sd]?|need|with verified|verified"
    demands = r"\b(?:i\s+need|need(?:s)?|must\s+have|must|required|require[sd]?|including|whose|with)\b"
    clauses = F.filter(F.regexp_extract_all(text, F.lit(rf"(?i){demands}[^.!?;]*"), F.lit(0)), lambda c: ~says(c, SOFT) | says(c, r"\b(?:must|required|need)\b"))
    # The mail cues of a clause stand behind its first demanding word.
    clauses = F.transform(clauses, lambda c: F.regexp_replace(c, rf"(?i)^{demands}", ""))
    some = lambda test: F.exists(clauses, test)
    mail, owned = r"\be-?mails?\b", r"\b(?:person|their|decision[- ]maker|verified\s+person|verified)\b"
    verified_only = says(text, r"\bonly leads with verified email\b|\bverified email(?:s)? only\b|\bmust have (?:a )?verified email\b|\bverified\s+person(?:'s)?\s+e-?mails?\b")
    person_mail = verified_only | some(lambda c: says(c, mail) & says(c, owned))
    close = {f: there & says(text, rf"\b(?:{near})\b[^.]{{0,40}}\b{f}\b|\b{f}\b[^.]{{0,40}}\b(?:required|only|must|need|verified)\b") for f, there in mentioned.items()}
    fields = dict(close)
    fields["website"] = close["website"] | says(text, r"\b(?:require[sd]?|must have|need|with|including|and)\b[^.]{0,120}\bwebsite\b") | some(lambda c: says(c, r"\bwebsite\b"))
    fields["email"] = close["email"] | person_mail | some(lambda c: says(c, mail) & ~says(c, r"\bcompany\b"))
    fields["personEmail"] = person_mail
    fields["companyEmail"] = some(lambda c: says(c, mail) & ~says(c, owned) & says(c, r"\bcompany\b"))
    for p in PLATFORMS:
        name = p[0].upper() + p[1:]
        fields[f"company{name}"] = _asked_of_company(text, p) | some(_in_clause_of_company(p))
        fields[f"person{name}"] = _asked_of_person(text, p) | some(_in_clause_of_person(p))
    return those(**fields)


def parse(prompts: DataFrame, column: str = "prompt", plan: str = "plan") -> DataFrame:
    """The prompts with a struct column `plan` of what each asks for; a null prompt asks for nothing, as an empty one.

    Arrays of fields come in a fixed order, whatever the prompt's. A column that is called as the plan is replaced. Repeated
    rows and other columns stay as they are; prompts of the same text are read once.
    """
    return once_each(prompts, [column], lambda texts: read_each(texts, "_once0", plan))


def read_each(prompts: DataFrame, column: str = "prompt", plan: str = "plan") -> DataFrame:
    """As parse(), by itself for each row and without a shuffle."""
    own = "_plan_"
    df = prompts.withColumn(f"{own}whole", F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " ")))
    col = lambda name: F.col(own + name)
    put = lambda df, **columns: df.withColumns({own + name: c for name, c in columns.items()})
    df = put(df, text=F.regexp_replace(col("whole"), r"(?i)\breal-estate\b", "real estate"))
    sizeless = without(col("text"), r"\b(?:with\s+)?(?:company\s+size\s+)?\d+\s*(?:to|-|–)\s*\d+\s*employees?\b", r"\bcompany\s+size\s+\d+\s*(?:to|-|–)\s*\d+\b", r"\b\d+\s*\+\s*employees?\b")
    df = put(df, size=_size(col("text")), quality=F.lower(found(col("text"), r"\b(?:(?:preferably|ideally)\s+)?(small|medium-sized|mid-sized|midmarket|large)\s+(?:companies|businesses|firms)\b", 1)), sizeless=sizeless)
    unwanted = r"\b(?:excluding|exclude|except|but\s+not|but\s+exclude|without)\s+"
    exclusions = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(col("sizeless"), F.lit(rf"(?i){unwanted}([^.,;]+)"), F.lit(1)), lambda x: F.trim(x)), lambda x: (x != "") & ~says(x, r"^specifying\b")))
    df = put(df, exclusions=exclusions, wanted=without(col("sizeless"), rf"{unwanted}[^.,;]+"))
    df = put(df, count=_count(col("wanted")))
    df = put(df, counted=_without_count(col("wanted"), F.when(col("count").isNotNull(), F.least(F.lit(RESULT_CAP), col("count")["requested"]))))
    # The last match of the preposition begins behind the last mark.
    df = put(df, marked=F.regexp_replace(col("counted"), rf"(?i)\b(?:in|near|within)\s+.+?(?=\s+(?:{PLACE_ENDS})\b|$)", "\x01$0"))
    df = put(df, found=_places(col("marked")))
    df = put(df, placed=F.when(F.size(col("found")) > 0, col("found")))
    america = F.when(says(col("text"), r"\b(?:united states|usa|u\.s\.a\.|u\.s\.)\b"), F.array(interpret(F.lit("US")).withField("original", F.lit(None).cast("string"))))
    leads = those(**{name: says(col("text"), "|".join(patterns)) for name, patterns in LEAD_PHRASES.items()})
    left = F.when(col("placed").isNotNull(), F.trim(F.replace(F.regexp_extract(col("marked"), r"^(.*)\x01", 1), F.lit("\x01"), F.lit("")))).otherwise(col("counted"))
    df = put(df, locations=F.coalesce(col("placed"), america, F.array().cast("array<struct<country string, state string, city string, region string, original string>>")), leads=leads, left=left)
    df = put(df, industry=_industry(col("left"), col("leads")))
    text, low = col("text"), F.lower(col("text"))
    company, contact = (those(**{f: low.contains(f) for f in fields}) for fields in (COMPANY_FIELDS, CONTACT_FIELDS))
    mentioned = {f: low.contains(f) for f in dict.fromkeys((*COMPANY_FIELDS, *CONTACT_FIELDS))}
    negated, verified = says(text, NEGATED), says(text, r"\bverified\b|\bverification\b")
    df = put(df, company=company, contact=contact, required=_required(text, mentioned), titles=F.array_distinct(those(**{t: low.contains(word) for word, t in TITLES.items()})), verify=verified & ~negated)
    df = put(df, mail_verified=~negated & says(text, r"\bverified\s+(?:decision[- ]makers?\s+|person(?:'s)?\s+)?e-?mails?\b|\be-?mails?\s+(?:must be\s+)?verified\b"))
    required, has = col("required"), lambda f: F.array_contains(col("required"), f)
    named = F.array_distinct(F.concat(col("company"), col("contact")))
    capital = lambda f: F.concat(F.upper(F.substring(f, 1, 1)), F.substr(f, F.lit(2)))
    near = lambda a, b: says(text, rf"\b{a}\b[^.]{{0,40}}\b{b}\b|\b{b}\b[^.]{{0,40}}\b{a}\b")
    checked = those(email=col("mail_verified") | has("personEmail") | has("email"), website=near("verified", "website"), phone=near("verified", "phone"), **{p: has(f"company{p.capitalize()}") | has(f"person{p.capitalize()}") for p in PLATFORMS})
    generic = says(text, SOCIALS)
    platforms = those(**{p: generic | says(text, r"\b(?:x/twitter|twitter|x account)\b" if p == "x" else rf"\b{p}\b") for p in ("linkedin", "facebook", "instagram", "x", "youtube")})
    score = found(text, r"\b(?:minimum|min)\s+score\s*(?:of\s*)?(\d{1,3})\b", 1).cast("int")
    count, size, places = col("count"), col("size"), col("locations")
    nothing = (F.size(col("industry")) == 0) & (F.size(col("leads")) == 0) & (F.size(places) == 0) & size.isNull() & count.isNull()
    relative = found(col("whole"), r"\b(?:near|within|around(?!\s+\d))\s+[^,.;]+")
    open_ = lambda said, why: F.struct(said.alias("text"), F.lit(why).alias("reason"))
    unknown = F.transform(F.filter(places, lambda p: p["country"] == ""), lambda p: open_(F.coalesce(p["original"], p["city"], p["region"], F.lit("")), "location could not be confidently resolved to a country or administrative area"))
    unresolved = F.concat(
        F.filter(
            F.array(
                F.when(says(col("whole"), "actively buying distressed properties"), open_(F.lit("actively buying distressed properties"), "requires evidence-based source classification")),
                F.when(nothing, open_(col("whole"), "no supported deterministic search criteria were recognized")),
                F.when(col("quality").isNotNull(), open_(col("quality"), "qualitative employee size was requested without a numeric range")),
            ),
            lambda x: x.isNotNull(),
        ),
        unknown,
        F.filter(
            F.array(
                F.when(relative.isNotNull() & ~says(relative, r"\b\d+\s*(?:mi|miles?|km|kilometers?)\b"), open_(F.trim(relative), "no search radius was specified")),
                F.when(count["requested"] > RESULT_CAP, open_(count["requested"].cast("string"), f"requested count was limited to the safety cap of {RESULT_CAP}")),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    where = F.array_join(F.transform(places, lambda p: F.concat_ws(", ", p["city"], p["state"], p["region"], F.nullif(p["country"], F.lit("")))), " and ")
    kind = F.replace(F.coalesce(F.get(col("leads"), F.lit(0)), F.get(col("industry"), F.lit(0)), F.lit("companies")), F.lit("_"), F.lit(" "))
    capped = F.when(count.isNotNull(), F.least(F.lit(RESULT_CAP), count["requested"]))
    staff = F.when(size.isNotNull(), F.concat(F.lit(" with "), F.concat_ws("-", size["min"].cast("string"), size["max"].cast("string")), F.when(size["max"].isNull(), "+").otherwise(""), F.lit(" employees"))).otherwise("")
    flags = lambda **columns: F.struct(*(c.alias(name) for name, c in columns.items()))
    mail = says(text, r"\be-?mails?\b")
    mail_required = col("mail_verified") | says(text, r"\b(?:must|required|need)\b[^.]{0,60}\be-?mails?\b")
    site_required = has("website") | says(text, r"\b(?:must|required|need)\b[^.]{0,40}\bwebsite\b") | says(text, r"\b(?:with|including|and)\b[^.]{0,120}\b(?:company\s+)?website\b")
    made = flags(
        target_type=F.when(says(text, r"\bqualified\s+leads?\b"), "QUALIFIED_LEADS").otherwise("COMPANIES"), industry=col("industry"), lead_types=col("leads"), locations=places, company_size=size, qualitative_size=col("quality"), company_fields=col("company"),
        person_fields=those(**{f: says(text, p) for f, p in PERSON_FIELDS.items()}), contact_fields=col("contact"), social_platforms=platforms, roles=col("titles"), required_fields=required,
        optional_fields=F.filter(named, lambda f: ~F.arrays_overlap(required, F.array(f, F.concat(F.lit("company"), capital(f)), F.concat(F.lit("person"), capital(f))))),
        preferred_fields=F.when(says(text, SOFT), F.array_except(named, required)).otherwise(F.array().cast("array<string>")),
        email=flags(requested=mail, required=mail_required, verified=col("mail_verified")), website=flags(requested=says(text, r"\bwebsite\b"), required=site_required),
        verification=flags(requested=col("verify"), required=col("verify"), fields=F.when(col("verify"), checked).otherwise(F.array().cast("array<string>"))), minimum_score=F.when(score.isNotNull(), F.least(F.lit(100), score)),
        requested_count=count["requested"], max_results=capped, count_intent=count["intent"], exclusions=col("exclusions"),
        search_intent=F.concat(F.concat_ws(" ", F.lit("find"), capped.cast("string"), kind, F.when(where != "", F.concat(F.lit("in "), where))), staff), unresolved=unresolved, original_prompt=col("whole"),
    )
    out = df.withColumn(plan, made)
    return out.drop(*(c for c in out.columns if c.startswith(own)))
