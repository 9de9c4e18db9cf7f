"""Text normalisers and classifiers as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal forms that are no part of a company's name.
LEGAL_FORMS = ("l l c", "llc", "ltd", "limited", "inc", "incorporated", "corp", "corporation")
#: Mailboxes of a company, not of a person.
GENERIC_MAILBOXES = (
    "info", "contact", "hello", "office", "support", "sales", "admin", "team", "inquiries", "enquiry", "enquiries", "noreply", "no-reply", "careers", "jobs",
    "billing", "accounts", "hr", "press", "media", "help",
)


@F.pandas_udf(T.StringType())
def _decomposed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9\s]", " "), r"\s+", " "))


def normal_text(text: Column) -> Column:
    """Lower-case letters and digits, one blank between words. Marks that decomposition leaves become blanks."""
    return _plain(_decomposed(F.lower(F.coalesce(text, F.lit("")))))


def normal_ascii(text: Column) -> Column:
    """normal_text for text that needs no decomposition: without Python."""
    return _plain(F.lower(F.coalesce(text, F.lit(""))))


def company_name(normal: Column) -> Column:
    """A normal text without the legal forms, wherever they stand."""
    return F.trim(F.regexp_replace(F.regexp_replace(normal, rf"\b({'|'.join(LEGAL_FORMS)})\b", ""), r"\s+", " "))


def national_phone(text: Column) -> Column:
    """Digits, without the leading 1 of eleven."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.nullif(F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits), F.lit(""))


def contact_phone(text: Column) -> Column:
    """Digits, with the plus sign if the number began with one."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits != "", F.concat(F.when(F.trim(text).startswith("+"), "+").otherwise(""), digits))


def match_phone(text: Column) -> Column:
    """Digits, only from ten on."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, digits)


def research_phone(text: Column) -> Column:
    """contact_phone, only from seven digits on."""
    return F.when(F.length(F.regexp_replace(text, "[^0-9]", "")) >= 7, contact_phone(text))


def source_phone(text: Column) -> Column:
    """Digits and every plus sign."""
    return F.nullif(F.regexp_replace(text, "[^0-9+]", ""), F.lit(""))


def email(text: Column) -> Column:
    """Lower case without blanks around; empty is null."""
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?1?[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"


def emails(text: Column) -> Column:
    """All addresses in lower case, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower))


def phones(text: Column) -> Column:
    """All phone numbers with their separators gone, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9+]", "")))


def is_generic_mailbox(address: Column) -> Column:
    local = F.lower(F.trim(F.substring_index(address, "@", 1)))
    return local.isin(*GENERIC_MAILBOXES) | local.contains("noreply") | local.contains("no-reply")


def score_band(score: Column) -> Column:
    return F.when(score < 40, "LOW").when(score < 70, "MEDIUM").when(score < 85, "HIGH").otherwise("VERY_HIGH")


def person_email(text: Column) -> Column:
    """The first address in a text if it is a person's: later addresses are not looked at."""
    first = F.lower(F.regexp_substr(text, F.lit(EMAIL)))
    return F.when(~is_generic_mailbox(first) & ~F.substring_index(first, "@", 1).isin("john", "jane") & ~first.endswith("@example.com"), first)


def title_role(title: Column) -> Column:
    """The role of a job title; rungs are tried in this order, so FOUNDER comes before CO-FOUNDER and takes it."""
    upper = F.upper(F.trim(title))
    out = F.when(upper == "", None)
    for word, role in (("FOUNDER", "FOUNDER"), ("CHIEF EXECUTIVE", "CEO"), ("CEO", "CEO"), ("OWNER", "OWNER"), ("PRESIDENT", "PRESIDENT"), ("MANAGING PARTNER", "MANAGING PARTNER"), ("PARTNER", "PARTNER"), ("DIRECTOR", "DIRECTOR"), ("MANAGER", "MANAGER")):
        out = out.when(upper.contains(word), role)
    return out.otherwise(upper)


#: US states by name, spaces left out, and their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "florida": "FL", "georgia": "GA", "illinois": "IL",
    "newyork": "NY", "northcarolina": "NC", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "texas": "TX", "utah": "UT", "virginia": "VA", "washington": "WA", "wisconsin": "WI",
}


def state_code(text: Column) -> Column:
    """Two letters in upper case, the code of a known name, or the trimmed text."""
    tidy = F.trim(text)
    names = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    known = F.try_element_at(names, F.regexp_replace(F.lower(tidy), r"\s+", ""))
    return F.when(tidy.rlike("^[A-Za-z]{2}$"), F.upper(tidy)).otherwise(F.coalesce(known, tidy))


def postal_code(text: Column) -> Column:
    """Upper case without blanks."""
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def source_email(text: Column) -> Column:
    """An address in lower case if it looks like one, else null."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), low)


def query_signature(text: Column) -> Column:
    """A query's letters and digits in lower case, one blank between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))


def address_parts(text: Column) -> list[Column]:
    """Street, city, state and ZIP of `street, city, ST 12345`."""
    pattern = r"([0-9]+ [A-Za-z0-9 .'-]+), ([A-Za-z .'-]+), ([A-Z]{2}) ([0-9]{5}(?:-[0-9]{4})?)"
    return [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).alias(n) for i, n in enumerate(("street", "city", "state", "zip"), 1)]
