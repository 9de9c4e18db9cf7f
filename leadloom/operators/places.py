"""Places of companies: countries, states, storable parts, the location that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of countries by code; a code stands for itself too.
COUNTRIES = {
    "US": ("usa", "united states", "united states of america"), "AE": ("uae", "united arab emirates"), "PK": ("pakistan",), "DE": ("germany", "deutschland"), "GB": ("uk", "united kingdom", "britain", "great britain"), "CA": ("canada",),
    "FR": ("france",), "AU": ("australia",), "IN": ("india",), "NL": ("netherlands",), "ES": ("spain",), "IT": ("italy",), "BR": ("brazil",), "MX": ("mexico",), "JP": ("japan",), "CN": ("china",), "SG": ("singapore",), "IE": ("ireland",),
    "NZ": ("new zealand",), "ZA": ("south africa",), "SA": ("saudi arabia",), "QA": ("qatar",), "EG": ("egypt",), "NG": ("nigeria",), "KE": ("kenya",),
}
#: The longest parts of a location that can be stored.
LONGEST = {"address_line1": 255, "address_line2": 255, "city": 120, "state": 100, "postal_code": 20}
#: Names of states by code.
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois",
    "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana",
    "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania",
    "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}


def country_code(value: Column) -> Column:
    """The two-letter code of a country's name or code; null for other words."""
    key = F.lower(F.trim(value))
    known = F.create_map(*(F.lit(x) for code, names in COUNTRIES.items() for name in (code.lower(), *names) for x in (name, code)))
    return F.coalesce(F.element_at(known, key), F.when(key.rlike("^[a-z]{2}$"), F.upper(key)))


def state_name(value: Column) -> Column:
    """A state's name in lower case, of its name or code."""
    key = F.replace(F.lower(F.trim(value)), F.lit("."), F.lit(""))
    names = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    return F.coalesce(F.element_at(names, key), key)


def states_agree(requested: Column, found: Column) -> Column:
    """Whether a state may be the requested one; an unknown one may."""
    unknown = (F.trim(F.coalesce(requested, F.lit(""))) == "") | (F.trim(F.coalesce(found, F.lit(""))) == "")
    return unknown | (state_name(requested) == state_name(found))


def inside(lat: Column, lon: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon of (lat, lon) corners: an odd number of its sides cross the ray to the east."""
    sides = [F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("a", "b", "c", "d"), (*p, *q)))) for p, q in zip(corners, [*corners[1:], corners[0]])]
    crosses = lambda s: ((s["a"] > lat) != (s["c"] > lat)) & (lon < (s["d"] - s["b"]) * (lat - s["a"]) / (s["c"] - s["a"]) + s["b"])
    return F.size(F.filter(F.array(*sides), crosses)) % 2 == 1


def storable(parts: dict[str, Column], country: Column) -> Column:
    """A struct of a location's parts as they can be stored: trimmed, too long ones gone, the country as a code; null if nothing is left."""
    kept = {k: F.when(F.length(F.trim(v)).between(1, LONGEST[k]), F.trim(v)) for k, v in parts.items()}
    kept["country"] = country_code(country)
    return F.when(F.coalesce(*kept.values()).isNotNull(), F.struct(*(v.alias(k) for k, v in kept.items())))


def main_location(locations: DataFrame) -> DataFrame:
    """One location for each company: the primary one, else the first; ties by time and id."""
    rank = F.struct((~F.coalesce("is_primary", F.lit(False))).alias("p"), "created_at", "id")
    value = F.struct(*(c for c in locations.columns if c != "company_id"))
    return locations.groupBy("company_id").agg(F.min_by(value, rank).alias("location"))
