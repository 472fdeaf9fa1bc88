"""Parsers of listing fields: address, opening hours, price level, attributes and reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nullif_empty, strip

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# Labels that are no attributes, and the keyword groups in the order in which they are tried.
NO_ATTRIBUTES = [
    "find a table", "place an order", "reserve a table", "order online", "add a photo", "suggest an edit", "share", "save",
    "nearby", "view all", "see all", "more", "directions", "send to phone", "nearby restaurants", "hotels", "things to do",
    "bars", "coffee", "takeout", "groceries", "attractions", "shopping", "nightlife", "gas stations", "pharmacies", "banks",
    "atms", "museums", "parks", "gyms", "spas", "hospitals", "clinics", "schools",
]
ATTRIBUTE_GROUPS = {
    "accessibility": ["wheelchair", "accessible", "hearing loop", "assistive", "listening device"],
    "payments_accepted": ["credit card", "debit card", "nfc mobile", "cash only", "checks"],
    "service_options": ["dine-in", "delivery", "takeout", "take-out", "no-contact", "curbside", "in-store shopping", "onsite service"],
    "highlights": ["great coffee", "great dessert", "great tea", "live music", "rooftop seating", "outdoor seating", "happy hour", "bar onsite", "fireplace", "waterfront"],
    "crowd": ["family-friendly", "groups", "tourists", "college student", "solo dining", "lgbtq", "kids"],
    "planning": ["reservation", "appointment"],
}
PRICE_WORDS = [("inexpensive", "$"), ("moderately expensive", "$$"), ("expensive", "$$$"), ("very expensive", "$$$$")]


def _first(values: Column, keep) -> Column:
    return F.get(F.filter(values, keep), F.lit(0))


def address_components(full: Column) -> Column:
    """struct(street, city, postal_code, country): parts by ' - ' if there are three or more, else by commas."""
    number = r"\b\d{4,10}\b"
    parts = lambda sep: F.filter(F.transform(F.split(full, sep), strip), lambda p: p != "")
    postal = lambda ps: nullif_empty(F.regexp_extract(_first(ps, lambda p: p.rlike(number)), number, 0))
    dash, comma = parts(" - "), parts(",")
    nd, nc = F.size(dash), F.size(comma)
    is_venue = lambda p: ~F.lower(p).rlike(r"^(floor|level)\s+\d") & ~F.lower(p).startswith("valet parking") & ~F.lower(p).startswith("parking available")
    venue = F.coalesce(_first(F.slice(dash, 1, F.greatest(nd - 2, F.lit(0))), is_venue), F.get(dash, F.lit(0)))
    at = F.array_position(F.transform(comma, lambda p: p.rlike(number)), F.lit(True)) - 1
    beside = strip(F.regexp_replace(F.get(comma, F.lit(1)), number, ""))
    city = (
        F.when(at >= 2, F.get(comma, (at - 1).cast("int")))
        .when((at == 1) & (nc >= 3), F.coalesce(nullif_empty(beside), F.get(comma, F.lit(2))))
        .when((at < 0) & (nc >= 3), F.get(comma, nc - 2))
    )
    by_dash = nd >= 3
    return F.struct(
        F.when(by_dash, venue).otherwise(F.get(comma, F.lit(0))).alias("street"),
        F.when(by_dash, F.get(dash, nd - 2)).otherwise(city).alias("city"),
        F.when(by_dash, postal(dash)).otherwise(postal(comma)).alias("postal_code"),
        F.when(by_dash, F.get(dash, nd - 1)).when(nc > 1, F.get(comma, nc - 1)).alias("country"),
    )


def open_flag(status: Column) -> Column:
    """False if closed, true if open or about to close, else null.  'Closed' is looked for first."""
    s = F.lower(strip(status))
    return F.when(s.startswith("closed"), False).when(s.startswith("closes soon") | s.startswith("closing soon") | s.startswith("open"), True)


def _starts(day: str):
    return lambda s: F.lower(s).startswith(day)


def _after(day: str):
    return lambda s: strip(F.ltrim(strip(F.substr(s, F.lit(len(day) + 1))), F.lit(",:")))


def hours_by_day(label: Column) -> Column:
    """map(day -> hours) of a label such as 'Monday, 9 AM to 9 PM; Tuesday, ...'; a later entry of a day wins."""
    text = F.regexp_replace(F.regexp_replace(label, "[–—]", "-"), r"(?U)\s+", " ")
    text = F.regexp_replace(text, rf"(?i)(?<=[^;]),\s*(?={'|'.join(DAYS)})", ";")
    segments = F.filter(F.transform(F.split(text, ";"), strip), lambda s: s != "")
    hours = []
    for day in DAYS:
        own = F.filter(segments, _starts(day))
        values = F.filter(F.transform(own, _after(day)), lambda v: v != "")
        hours.append(F.struct(F.lit(day).alias("key"), F.get(F.reverse(values), F.lit(0)).alias("value")))
    return F.map_from_entries(F.filter(F.array(*hours), lambda e: e["value"].isNotNull()))


def valid_hours(hours: Column) -> Column:
    """Only entries with AM, PM or closed."""
    return F.map_filter(hours, lambda _, v: v.rlike("(?i)AM|PM|closed"))


def checked_hours(hours: Column, is_open: Column) -> Column:
    """No hours at all if five days or more are closed while the place is open."""
    closed = F.size(F.filter(F.map_values(hours), lambda v: F.lower(strip(v)) == "closed"))
    return F.when(is_open & (closed >= 5), F.map_filter(hours, lambda _, v: F.lit(False))).otherwise(hours)


def count_days(hours: Column) -> Column:
    return F.size(F.filter(F.map_values(hours), lambda v: v.isNotNull()))


def price_level(raw: Column) -> Column:
    """Dollar signs in the text, else of the first price word that it contains."""
    s = strip(raw)
    signs = F.coalesce(nullif_empty(F.regexp_extract(s, r"(\${1,4})(?:\s|$|·)", 1)), nullif_empty(F.regexp_extract(s, r"(?i)Price:\s*(\${1,4})", 1)))
    words = F.coalesce(*[F.when(F.lower(s).contains(w), v) for w, v in PRICE_WORDS])
    return F.coalesce(signs, words)


def is_valid_description(c: Column) -> Column:
    t = strip(c)
    # fixed values: patterns of texts that are no description
    bad = (
        t.rlike("^[✔✓✅☑]")
        | t.rlike("(?i)(updated|confirmed) by this business")
        | t.rlike(r"(?U)^\d+\.\d+\s+\w")
        | t.rlike(r"(?i)\b(wheelchair|accessible|accessibility|hearing loop|listening device|parking lot|parking garage|restroom|assisted listening)\b")
        | t.rlike(r"(?iU)^[\w\s&-]+(restaurant|café|cafe|bar|lounge|bistro|brasserie)[\s·•]*$")
    )
    return F.coalesce((F.length(t) >= 30) & ~bad, F.lit(False))


def is_garbage_attribute(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    # fixed values: patterns of labels that are no attribute
    return (
        (t == "")
        | (F.length(t) > 60)
        | F.lower(t).isin(NO_ATTRIBUTES)
        | t.rlike(r"(?U)^\+[\d\s\-\.\(\)]{6,}$")
        | t.rlike(r"(?iU)^[\w.-]+\.[a-z]{2,6}(/\S*)?$")
        | t.rlike(r"(?i)^[A-Z0-9]{4,6}\+[A-Z0-9]{2,4}")
        | F.lower(t).startswith("located in:")
        | t.rlike(r"(?i)^floor\s+\d")
    )


def clean_attributes(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, strip), lambda t: ~is_garbage_attribute(t)))


def attribute_group(tag: Column) -> Column:
    """The first group with a keyword in the tag."""
    t = F.lower(tag)
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(t, k)), group) for group, words in ATTRIBUTE_GROUPS.items()])


def attribute_groups(tags: Column) -> Column:
    """A struct with the distinct tags of each group."""
    of = lambda group: lambda t: F.coalesce(attribute_group(t) == group, F.lit(False))
    return F.struct(*[F.array_distinct(F.filter(tags, of(g))).alias(g) for g in ATTRIBUTE_GROUPS])


def all_attributes(*lists: Column) -> Column:
    """The lists' values, trimmed, once each, joined by commas; values of one character or with an icon are dropped."""
    joined = F.concat(*[F.coalesce(v, F.array().cast("array<string>")) for v in lists])
    values = F.transform(joined, lambda v: strip(F.coalesce(v, F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(values, lambda v: (F.length(v) > 1) & ~v.startswith(""))), ", ")


def reviews_text(reviews: Column) -> Column:
    """'author (rating★): text [date]' for each review, joined by ' | '."""
    one = lambda r: F.concat(F.coalesce(r["author"], F.lit("Anonymous")), F.lit(" ("), F.coalesce(r["rating"].cast("string"), F.lit("")), F.lit("★): "), F.left(F.coalesce(r["text"], F.lit("")), F.lit(150)), F.lit(" ["), F.coalesce(r["date"], F.lit("")), F.lit("]"))
    return F.coalesce(F.array_join(F.transform(reviews, one), " | "), F.lit(""))


def strip_prefix(c: Column, prefix: str) -> Column:
    return strip(F.regexp_replace(c, rf"(?i)^{prefix}:\s*", ""))


def longest_candidate(texts: Column) -> Column:
    """The longest text of at least 30 characters and five words that does not begin with a digit; the first of equal ones."""
    trimmed = F.filter(F.transform(texts, strip), lambda t: (F.length(t) >= 30) & (F.size(F.split(t, " ")) >= 5) & ~t.rlike(r"^\d"))
    best = F.aggregate(trimmed, F.lit(None).cast("string"), lambda acc, t: F.when(acc.isNull() | (F.length(t) > F.length(acc)), t).otherwise(acc))
    return F.when(is_valid_description(best), best)


def link_union(*lists: Column) -> Column:
    """The values of several lists in order and once each; null lists count as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(v, F.array().cast("array<string>")) for v in lists]))


#: How many of a list are kept.
FIRST_REVIEWS, FIRST_IMAGES, EMAIL_PAGES, RENDERED_PAGES = 5, 10, 6, 4


def first_of(values: Column, n: int) -> Column:
    """The first n values of a list."""
    return F.slice(values, 1, n)
