"""Clean-up, extraction and classification of names, places and contacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritgrid.functions.exprs import col, first_rule, has, lookup, once
from meritgrid.functions.text import filled, lower_name, squeeze, without_parentheses, word_list
from meritgrid.rules import cleaning as rules
from meritgrid.rules.filters import CITIES

NOTHING = "array<string>"


def title_case(text: Column) -> Column:
    """Every letter run starts with a capital, the rest is lower case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))), "")


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def _replace_all(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _regex_all(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for pattern, new in pairs:
        text = F.regexp_replace(text, "(?i)" + pattern, new)
    return text


# --- names ---------------------------------------------------------------------------------


def tidy_hospital_name(name: Column | str) -> Column:
    """Spaces squeezed, camelCase split, all-upper and all-lower words in title case."""
    text = F.regexp_replace(squeeze(filled(name)), "([a-z])([A-Z])", "$1 $2")
    one_case = lambda w: ((w == F.upper(w)) | (w == F.lower(w))) & w.rlike(r"\p{L}")
    fixed = F.transform(word_list(text), lambda w: F.when(one_case(w), title_case(w)).otherwise(w))
    return F.array_join(fixed, " ")


def registry_name(name: Column | str) -> Column:
    """Outer punctuation off, misreadings and abbreviations fixed, small words lower case."""
    text = F.trim(squeeze(filled(name)), F.lit(".,;:-_()[]{}|"))
    text = _regex_all(_replace_all(text, rules.MISREAD_WORDS), [*rules.ABBREVIATIONS, *rules.MORE_ABBREVIATIONS])
    small = lambda w: F.lower(w).isin(rules.SMALL_WORDS)
    return F.array_join(F.transform(word_list(text), lambda w: F.when(small(w), F.lower(w)).otherwise(capitalised(w))), " ")


def document_name(name: Column | str) -> Column:
    """Variant for document lines: personal titles dropped, abbreviations written out."""
    text = F.regexp_replace(squeeze(filled(name)), r"(?i)^(Dr\.?|Mr\.?|Ms\.?|Mrs\.?)\s+", "")
    return F.trim(_regex_all(text, rules.ABBREVIATIONS))


def portal_name(name: Column | str) -> Column:
    """Variant for the portal: trailing commas and periods off, literal spellings replaced."""
    return _replace_all(F.rtrim(squeeze(filled(name)), F.lit(".,")), rules.PORTAL_SPELLINGS)


def without_location_suffix(name: Column | str) -> Column:
    """Name without ``, city, state, India`` and shorter forms at its end."""
    text = squeeze(filled(name))
    for pattern in (r",\s*[A-Za-z\s]+,\s*[A-Za-z\s]+,\s*India$", r",\s*[A-Za-z\s]+,\s*India$", r",\s*India$"):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def clean_text(text: Column | str) -> Column:
    """Spaces squeezed, symbols other than basic punctuation dropped."""
    return F.regexp_replace(squeeze(filled(text)), r"(?U)[^\w\s\-\.,;:()]", "")


# --- places --------------------------------------------------------------------------------


def _part(parts: Column, from_end: int) -> Column:
    return F.trim(F.try_element_at(parts, F.lit(-from_end)))


def place_parts(address: Column | str) -> Column:
    """struct(city, state, country) from the last comma parts; missing parts are blank."""
    text = filled(address)
    parts = F.split(text, ",")
    n = F.size(parts)
    get = lambda need, k: F.when(n >= need, _part(parts, k)).otherwise("")
    return F.struct(get(3, 3).alias("city"), get(2, 2).alias("state"), get(1, 1).alias("country"))


def place_in_name(name: Column | str) -> Column:
    """struct(city, state, country): the three or two comma parts after the name."""
    text = filled(name)
    three = F.regexp_extract(text, r",\s*([^,]+),\s*([^,]+),\s*([^,]+)$", 0) != ""
    two = F.regexp_extract(text, r",\s*([^,]+),\s*([^,]+)$", 0) != ""
    parts = F.split(text, ",")
    return F.struct(
        F.when(three, _part(parts, 3)).otherwise("").alias("city"),
        F.when(three | two, _part(parts, 2)).otherwise("").alias("state"),
        F.when(three | two, _part(parts, 1)).otherwise("India").alias("country"),
    )


def tidy_place(place: Column, absent: Sequence[str] = ("unknown", "na", "n/a", "")) -> Column:
    """Title case; words for a missing value become Unknown."""
    return F.when(F.lower(place).isin(list(absent)), "Unknown").otherwise(title_case(squeeze(place)))


def listed_place(name: Column | str, state_in_brackets: bool = False) -> Column:
    """struct(city, state, address) of portal names ``Name, City, State, India``."""
    text = filled(name)
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    n = F.size(parts)
    home = F.lower(F.try_element_at(parts, F.lit(-1))).isin(rules.HOME_COUNTRIES)
    state = F.when(home & (n >= 3), F.try_element_at(parts, F.lit(-2))).otherwise("Unknown")
    city = (
        F.when(home & (n >= 4), F.try_element_at(parts, F.lit(-3)))
        .when(home & (n == 3), F.try_element_at(parts, F.lit(-2)))
        .otherwise("Unknown")
    )
    absent = ("unknown", "india", "bharat", "")
    if state_in_brackets:
        bracket = F.trim(F.regexp_extract(text, r"\(([^)]+)\)$", 1))
        state = F.when(bracket != "", bracket).otherwise(state)
        absent = ("unknown", "na", "n/a", "")
    rest = F.array_join(F.slice(parts, 2, F.greatest(n, F.lit(1))), ", ")
    return F.struct(
        tidy_place(city, absent).alias("city"),
        tidy_place(state, absent).alias("state"),
        F.when(n > 1, rest).otherwise("").alias("address"),
    )


def _place_tokens(text: Column) -> Column:
    tokens = F.transform(F.split(text, r"[,\-\|/]+|\s+-\s+"), lambda t: F.trim(t))
    return F.filter(tokens, lambda t: t != "")


def _last_two(tokens: Column, absent: str) -> Column:
    n = F.size(tokens)
    return (
        F.when(n >= 2, F.concat_ws(", ", F.try_element_at(tokens, F.lit(-2)), F.try_element_at(tokens, F.lit(-1))))
        .when(n == 1, F.try_element_at(tokens, F.lit(1)))
        .otherwise(absent)
    )


def tidy_location(text: Column) -> Column:
    """Last two place tokens without countries, markup remains and repeats."""
    kept = F.filter(
        _place_tokens(filled(text)),
        lambda t: ~F.lower(t).rlike("u003c|u003e") & ~F.lower(t).isin(rules.GENERIC_PLACES),
    )
    distinct = F.aggregate(
        kept,
        F.array().cast(NOTHING),
        lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.array_append(acc, t)),
    )
    return once(distinct, lambda places: _last_two(places, "Unknown Location"))


def location_of(city: Column, state: Column, *fallbacks: Column) -> Column:
    """Location from city and state, else from the first filled fallback text."""
    both = F.when((filled(city) != "") & (filled(state) != ""), F.concat_ws(", ", city, state))
    return tidy_location(F.coalesce(both, *[F.nullif(filled(f), F.lit("")) for f in fallbacks], F.lit("")))


def _separator_text(text: Column) -> Column:
    """Lower case with one space, dashes as spaces, commas followed by one space."""
    lowered = squeeze(F.lower(filled(text)))
    return F.regexp_replace(F.regexp_replace(lowered, r"\s*[-–—]\s*", " "), r"\s*,\s*", ", ")


def _name_tokens(text: Column) -> Column:
    return F.filter(F.split(_separator_text(text), r"[,\-\s]+"), lambda t: t != "")


def name_without_place(name: Column | str, location: Column | str, countries: Sequence[str] = ("india", "bharat")) -> Column:
    """Name tokens without the trailing ones that occur in the location, in any order."""
    places = F.concat(_name_tokens(filled(location)), F.array(*[F.lit(c) for c in countries]))

    def shortened(tokens: Column) -> Column:
        other = once(places, lambda p: F.transform(tokens, lambda t, i: F.when(~F.array_contains(p, t), i)))
        return F.array_join(F.slice(tokens, F.lit(1), F.coalesce(F.array_max(other) + 1, F.lit(0))), " ")

    return once(_name_tokens(squeeze(without_parentheses(filled(name)))), shortened)


def suggestion_key(name: Column | str, location: Column | str) -> Column:
    """Duplicate key of suggestions: name without place, and sorted location tokens."""
    def key(place: Column) -> Column:
        base = name_without_place(unify_company(filled(name)), place, ("india",))
        places = F.filter(_name_tokens(place), lambda t: t != "india")
        return F.concat_ws("|", unify_company(base), F.array_join(F.array_sort(places), " "))

    return once(unify_company(filled(location)), key)


def unify_company(text: Column) -> Column:
    lowered = squeeze(F.lower(text))
    return _replace_all(lowered, [("private limited", "pvt. ltd."), ("pvt ltd", "pvt. ltd.")])


def display_line(name: Column | str, location: Column | str) -> Column:
    """``name - city, state`` for suggestion lists."""
    kept = F.filter(_place_tokens(filled(location)), lambda t: ~F.lower(t).isin(rules.HOME_COUNTRIES))
    where = once(kept, lambda tokens: _last_two(tokens, ""))
    return once(
        F.struct(name_without_place(name, location).alias("text"), where.alias("where")),
        lambda x: F.when(x["where"] != "", F.concat_ws(" - ", x["text"], x["where"])).otherwise(x["text"]),
    )


def display_details(name: Column | str, address: Column | str, source: Column | str, rating: Column) -> Column:
    """Name, short address, star rating and source joined by dots."""
    where = filled(address)
    parts = F.split(where, ",")
    short = F.when(F.size(parts) > 2, F.concat_ws(", ", _part(parts, 2), _part(parts, 1))).otherwise(where)
    shown = F.when((where != "") & (where != "Location to be verified"), short)
    stars = F.when(rating > 0, F.concat(F.lit("★ "), rating.cast("string")))
    origin = F.when(filled(source) != "", F.concat(F.lit("("), col(source), F.lit(")")))
    return F.concat_ws(" • ", filled(name), shown, stars, origin)


def known_state(state: Column | str) -> Column:
    """Spelling fixed and matched to the state list without regard to case."""
    titled = tidy_place(filled(state))
    fixed = lookup(titled, rules.TITLE_STATE_SPELLINGS)
    text = F.coalesce(fixed, titled)
    return F.coalesce(lookup(F.lower(text), {s.lower(): s for s in rules.STATES}), text)


def plain_state(state: Column | str) -> Column:
    text = squeeze(filled(state))
    return F.coalesce(lookup(text, rules.STATE_SPELLINGS), text)


def state_in_address(address: Column | str) -> Column:
    """First state named in the address, else by short form, else Unknown."""
    text = F.lower(filled(address))
    named = first_rule(text, [([s.lower()], s) for s in rules.STATES], None)
    short = first_rule(text, [([a], s) for a, s in rules.STATE_SHORT_FORMS], "Unknown")
    return F.coalesce(named, short)


def state_in_name(name: Column | str) -> Column:
    text = F.lower(filled(name))
    return first_rule(text, [([s.lower()], s) for s in rules.STATES_IN_NAMES], "")


def cities_in(text: Column | str, gazetteer: Sequence[str] = tuple(CITIES)) -> Column:
    """Known cities found in the text, in list order."""
    lowered = F.lower(filled(text))
    return once(lowered, lambda t: F.filter(F.array(*[F.lit(c) for c in gazetteer]), lambda c: F.contains(t, F.lower(c))))


def country_of_name(name: Column | str) -> Column:
    lowered = F.lower(filled(name))
    return first_rule(lowered, [([w.lower() for w in words], c) for words, c in rules.COUNTRY_BY_NAME], "India")


def country_of_place(location: Column | str) -> Column:
    return first_rule(F.lower(filled(location)), rules.COUNTRY_BY_PLACE, "Unknown")


def region_of(name: Column | str, location: Column | str, places: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Region by place words of the location, else by brand words of the name, else india.

    ``places`` adds city and state lists per region to the country words.
    """
    lists = {r: [*words, *(places or {}).get(r, [])] for r, words in rules.REGION_BY_PLACE.items()}
    by_place = first_rule(F.lower(filled(location)), [(w, r) for r, w in lists.items()], None)
    return F.coalesce(by_place, first_rule(F.lower(filled(name)), rules.REGION_BY_BRAND, "india"))


def us_city(address: Column | str, state: Column | str) -> Column:
    """City before ``, ST 12345``, else an address part that does not start with a digit."""
    text, st = filled(address), filled(state)
    literal = F.regexp_replace(st, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"([^,]+),\s*"), literal, F.lit(r"\s*\d{5}"))
    hit = F.try_element_at(F.regexp_extract_all(text, pattern, F.lit(1)), F.lit(1))
    exact = F.when(st != "", F.trim(hit))
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    usable = lambda k: F.when(
        (F.size(parts) >= max(k, 2)) & ~_part(parts, k).rlike(r"^\d+") & (F.length(_part(parts, k)) > 2), _part(parts, k)
    )
    return F.coalesce(F.nullif(exact, F.lit("")), usable(3), usable(2), F.lit(""))


def zip_code(address: Column | str) -> Column:
    return F.regexp_extract(filled(address), r"\b(\d{5}(?:-\d{4})?)\b", 1)


PHONE = r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"


def has_phone(text: Column | str) -> Column:
    return filled(text).rlike(PHONE)


def phone_of(text: Column | str) -> Column:
    return F.regexp_extract(filled(text), r"(\d{3}-\d{3}-\d{4}|\d{10}|\d{3}\.\d{3}\.\d{4})", 1)


def us_place(address: Column | str) -> Column:
    """struct(state, zip_code, country): US state and ZIP, else a country word."""
    text = filled(address)
    state = F.regexp_extract(text, r"\b([A-Z]{2})\s+(\d{5}(?:-\d{4})?)\b", 1)
    number = F.regexp_extract(text, r"\b([A-Z]{2})\s+(\d{5}(?:-\d{4})?)\b", 2)
    country = F.when(state != "", "United States").otherwise(first_rule(F.lower(text), rules.ADDRESS_COUNTRIES, ""))
    return F.struct(state.alias("state"), number.alias("zip_code"), country.alias("country"))


def city_state_zip(address: Column | str) -> Column:
    """struct(city, state, zip_code) from ``City, ST 12345``, else separate finds."""
    text = filled(address)
    pattern = r"([A-Za-z\s]+),\s*([A-Z]{2})\s*(\d{5})"
    full = F.regexp_extract(text, pattern, 0) != ""
    return F.struct(
        F.when(full, F.trim(F.regexp_extract(text, pattern, 1))).otherwise("").alias("city"),
        F.when(full, F.regexp_extract(text, pattern, 2)).otherwise(F.regexp_extract(text, r"\b([A-Z]{2})\b", 1)).alias("state"),
        F.when(full, F.regexp_extract(text, pattern, 3)).otherwise(F.regexp_extract(text, r"\b(\d{5})\b", 1)).alias("zip_code"),
    )


# --- classes and keywords ------------------------------------------------------------------


def facility_type(name: Column | str, rule_list: str) -> Column:
    """Facility type by one of the ordered word lists; uploads keep an unknown type."""
    rule_rows, default = rules.FACILITY_RULES[rule_list]
    lowered = lower_name(name)
    if default is None:
        return F.coalesce(first_rule(lowered, rule_rows, None), F.trim(filled(name)))
    return first_rule(lowered, rule_rows, default)


def facility_type_by_size(name: Column | str, n_specialties: Column) -> Column:
    """Web variant: without a word hit the number of specialties decides."""
    named = facility_type(name, "web")
    sized = F.when(n_specialties > 5, "Multi-specialty Hospital").when(n_specialties > 1, "Specialty Hospital")
    return F.when(named == "General Hospital", F.coalesce(sized, named)).otherwise(named)


def specialties(name: Column | str) -> Column:
    lowered = F.lower(filled(name))
    found = [F.when(has(lowered, *w), F.array(*[F.lit(s) for s in out])) for w, out in rules.SPECIALTIES]
    none = F.array().cast(NOTHING)
    lists = [F.array(F.lit(rules.BASE_SPECIALTY)), *[F.coalesce(f, none) for f in found]]
    return F.array_distinct(F.concat(*lists))


def _all_words(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit(r"(\w+)"), F.lit(1))


def _acronym(tokens: Column, shortest: int) -> Column:
    return F.when(F.size(tokens) > 1, F.array_join(F.transform(tokens, lambda w: F.left(w, F.lit(1))), ""))


def _keyword_set(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.concat(*lists), lambda k: k.isNotNull() & (k != ""))))


def search_keywords(name: Column | str, country: Column | str, extra: Sequence[str] = ()) -> Column:
    """Name, words over two letters, acronym of words over three, country, constants."""
    text = F.lower(filled(name))
    tokens = _all_words(text)
    long_words = F.filter(tokens, lambda w: F.length(w) > 3)
    return _keyword_set(
        F.array(text),
        F.filter(tokens, lambda w: F.length(w) > 2),
        F.array(_acronym(long_words, 3), F.lower(filled(country))),
        F.array(*[F.lit(e) for e in extra]) if extra else F.array().cast(NOTHING),
    )


def pathology_keywords(name: Column | str, country: Column | str) -> Column:
    return search_keywords(name, country, [*rules.PATHOLOGY_TERMS, *rules.PATHOLOGY_KEYWORDS])


def lab_feed_keywords(name: Column | str, locations: Column) -> Column:
    """Name, words of three letters or more, their acronym, locations and constants."""
    text = F.lower(filled(name))
    tokens = F.filter(_all_words(text), lambda w: F.length(w) >= 3)
    acronym = _acronym(tokens, 2)
    return _keyword_set(
        F.array(text),
        tokens,
        F.array(F.when(F.length(acronym) > 2, acronym)),
        F.transform(F.coalesce(locations, F.array().cast(NOTHING)), F.lower),
        F.array(*[F.lit(k) for k in rules.LAB_FEED_KEYWORDS]),
    )


def upload_cert_names(cert_text: Column | str) -> Column:
    """Uploaded list split on comma, semicolon or pipe; blanks dropped."""
    return F.filter(F.transform(F.split(filled(cert_text), "[,;|]"), lambda p: F.trim(p)), lambda p: p != "")


def upload_cert_name(raw: Column) -> Column:
    """Full certification name by equal word, else containment either way, else as given."""
    lowered = F.lower(F.trim(raw))
    partial = None
    for key, value in rules.UPLOAD_CERTS.items():
        test = F.contains(lowered, F.lit(key)) | F.contains(F.lit(key), lowered)
        partial = F.when(test, F.lit(value)) if partial is None else partial.when(test, F.lit(value))
    return F.coalesce(lookup(lowered, rules.UPLOAD_CERTS), partial, F.trim(raw))


def upload_cert_type(name: Column) -> Column:
    return first_rule(F.lower(name), rules.UPLOAD_CERT_TYPES, "Healthcare Accreditation")


def upload_cert_impact(name: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Impact from a weight table by containment either way, else by type words."""
    lowered = F.lower(name)
    default = first_rule(lowered, rules.UPLOAD_CERT_IMPACTS, 5.0)
    listed = None
    for key, value in (weights or {}).items():
        k = F.lit(key.lower())
        test = F.contains(lowered, k) | F.contains(k, lowered)
        listed = F.when(test, F.lit(float(value))) if listed is None else listed.when(test, F.lit(float(value)))
    return default if listed is None else F.coalesce(listed, default)


def feed_cert_kind(name: Column | str) -> Column:
    """Certification kind of external feeds."""
    text = F.lower(filled(name))
    iso = (
        F.when(has(text, "15189"), "ISO_15189").when(has(text, "9001"), "ISO_9001").when(has(text, "13485"), "ISO_13485").otherwise("ISO_OTHER")
    )
    return (
        F.when(has(text, "joint commission international") | (F.trim(text) == "jci"), "JCI")
        .when(has(text, "iso"), iso)
        .when(has(text, "cap") & has(text, "college of american pathologists", "accreditation"), "CAP")
        .otherwise(first_rule(text, rules.FEED_CERT_RULES, "OTHER"))
    )


# --- addresses on the web ------------------------------------------------------------------


def full_url(url: Column | str) -> Column:
    """URL with a scheme; null when there is no host."""
    text = filled(url)
    whole = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_extract(whole, r"^https?://([^/?#]*)", 1)
    return F.when(host != "", whole)


def name_from_url(url: Column | str, strip_www: bool = False) -> Column:
    """Organisation name from the first host label, else the first path segment."""
    text = filled(url)
    host = F.lower(F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    if strip_www:
        host = F.regexp_replace(host, r"^www\.", "")
    label = F.replace(F.split(host, r"\.")[0], F.lit("-"), F.lit(" "))
    path = F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/+([^/?#]*)", 1)
    short = F.length(label) < 3
    name = F.trim(F.when(short, F.replace(path, F.lit("-"), F.lit(" "))).otherwise(label))
    return F.when(name != "", title_case(name)).otherwise("New Organization")
