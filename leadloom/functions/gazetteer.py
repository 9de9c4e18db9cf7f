"""Countries, states and cities by their names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.operators.places import STATES

#: Countries and the names they go by beside their own.
COUNTRIES = {
    "US": ("us", "usa", "united states", "united states of america", "america"), "United Kingdom": ("uk", "united kingdom", "britain", "england"), "Canada": (), "Mexico": (), "Germany": ("germany", "deutschland"), "France": (), "Spain": (), "Italy": (),
    "Netherlands": ("netherlands", "holland"), "Belgium": (), "Switzerland": (), "Austria": (), "Sweden": (), "Norway": (), "Denmark": (), "Finland": (), "Ireland": (), "Portugal": (), "Poland": (), "Greece": (), "Czechia": ("czechia", "czech republic"),
    "Romania": (), "Hungary": (), "Ukraine": (), "Turkey": ("turkey", "turkiye"), "United Arab Emirates": ("uae", "united arab emirates"), "Saudi Arabia": (), "Qatar": (), "Kuwait": (), "Bahrain": (), "Oman": (), "Israel": (), "Jordan": (), "Egypt": (),
    "Pakistan": (), "India": (), "Bangladesh": (), "Sri Lanka": (), "China": (), "Japan": (), "South Korea": ("south korea", "korea"), "Singapore": (), "Malaysia": (), "Indonesia": (), "Thailand": (), "Vietnam": (), "Philippines": (), "Australia": (),
    "New Zealand": (), "Brazil": (), "Argentina": (), "Chile": (), "Colombia": (), "Peru": (), "South Africa": (), "Nigeria": (), "Kenya": (), "Morocco": (),
}
#: Cities with their country and state.
CITIES = {
    "Dubai": ("United Arab Emirates", None), "Abu Dhabi": ("United Arab Emirates", None), "Lahore": ("Pakistan", None), "Karachi": ("Pakistan", None), "Islamabad": ("Pakistan", None), "Berlin": ("Germany", None), "Munich": ("Germany", None),
    "Hamburg": ("Germany", None), "Frankfurt": ("Germany", None), "London": ("United Kingdom", None), "Paris": ("France", None), "Toronto": ("Canada", "Ontario"), "Vancouver": ("Canada", "British Columbia"),
}
#: The cities that a search in a country, or a state of it, spreads to.
CITIES_OF = {
    ("US", "Texas"): (
        "Houston", "Dallas", "Austin", "San Antonio", "Fort Worth", "El Paso", "Arlington", "Plano", "Corpus Christi", "Lubbock", "Laredo", "Irving", "Frisco", "McKinney", "Amarillo", "Brownsville", "Waco", "Denton", "Midland", "Abilene", "Beaumont",
        "Round Rock", "Tyler", "Pearland", "Sugar Land",
    ),
    ("US", "California"): ("Los Angeles", "San Francisco", "San Diego", "San Jose", "Sacramento", "Oakland", "Fresno", "Irvine", "Santa Ana", "Long Beach", "Anaheim", "Bakersfield"),
    ("US", "New York"): ("New York", "Buffalo", "Rochester", "Albany", "Syracuse", "Yonkers"),
    ("US", "Florida"): ("Miami", "Orlando", "Tampa", "Jacksonville", "Fort Lauderdale", "St. Petersburg", "Tallahassee"),
    ("Germany", None): ("Berlin", "Munich", "Hamburg", "Frankfurt", "Cologne", "Stuttgart", "Dusseldorf"),
    ("United Arab Emirates", None): ("Dubai", "Abu Dhabi", "Sharjah"),
    ("Pakistan", None): ("Lahore", "Karachi", "Islamabad", "Rawalpindi", "Faisalabad"),
    ("United Kingdom", None): ("London", "Manchester", "Birmingham", "Leeds", "Glasgow"),
}

PLACE = "struct<country string, state string, city string, region string>"


def country_names() -> dict[str, str]:
    return {name: country for country, names in COUNTRIES.items() for name in (names or (country.lower(),))}


def state_names() -> dict[str, str]:
    return {name: state.title() for code, state in STATES.items() for name in (code, state)}


def entries() -> list[tuple[str, str, str | None, str | None]]:
    """Every place that is known by a name: (name, country, state, city), each name once, as a country, a state or a city in this order.

    Names of two letters are left out, since they are words too.
    """
    found = [(name, country, None, None) for name, country in country_names().items()] + [(name, "US", state, None) for name, state in state_names().items()]
    found += [(city.lower(), country, state, city) for city, (country, state) in CITIES.items()]
    found += [(city.lower(), country, state, city) for (country, state), cities in CITIES_OF.items() for city in cities]
    first: dict[str, tuple] = {}
    for entry in found:
        if len(entry[0]) > 2:
            first.setdefault(entry[0], entry)
    return list(first.values())


def literal_map(pairs: dict[str, str]) -> Column:
    """A map of constants, made by one call however many pairs it has."""
    return F.expr("map(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for pair in pairs.items() for x in pair) + ")")


def _known(names: dict[str, str], value: Column) -> Column:
    return F.try_element_at(literal_map(names), F.replace(F.lower(F.trim(value)), F.lit("."), F.lit("")))


def capitalised(text: Column) -> Column:
    """Every word with a capital first letter and otherwise as it is."""
    return F.array_join(F.transform(F.split(text, r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def interpret(raw: Column) -> Column:
    """A place of free text as a struct of country, state, city and region.

    Of parts between commas the first is a city and the last tells its country or state; a lone name is looked up as country, state and city in
    this order. What nobody knows is a city without a country, whose country is empty.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)^the\s+", ""), r"[?.!,]+$", ""))
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    none = F.lit(None).cast("string")

    def place(country: Column, state: Column = none, city: Column = none, region: Column = none) -> Column:
        return F.struct(country.alias("country"), state.alias("state"), city.alias("city"), region.alias("region"))

    head, tail, middle = capitalised(F.get(parts, F.lit(0))), F.try_element_at(parts, F.lit(-1)), capitalised(F.get(parts, F.lit(1)))
    # The last part, or the lone name, is what a country or state is looked up by.
    name = F.when(F.size(parts) < 2, text).otherwise(tail)
    country, state = _known(country_names(), name), _known(state_names(), name)
    city = F.try_element_at(literal_map({c.lower(): c for c in CITIES}), F.lower(text))
    of = lambda i: F.try_element_at(literal_map({c: v[i] or "" for c, v in CITIES.items()}), city)
    return (
        F.when(F.size(parts) < 2, F.when(country.isNotNull(), place(country)).when(state.isNotNull(), place(F.lit("US"), state)).when(city.isNotNull(), place(of(0), F.nullif(of(1), F.lit("")), city)).otherwise(place(F.lit(""), none, capitalised(text))))
        .when(country.isNotNull(), place(country, F.when(F.size(parts) > 2, middle), head))
        .when(state.isNotNull(), place(F.lit("US"), state, head))
        .otherwise(place(F.lit(""), none, head, capitalised(tail)))
    )
