"""Rows of outreach sheets: the 26 columns, what is new against a sheet, sent marks and cell ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import all_attributes, reviews_text
from ..functions.text import strip
from .dedup import greedy_dedup

#: Names of the columns of a sheet row, in order.
SHEET = [
    "name", "phone", "email", "website", "category", "rating", "reviews", "full_address", "maps_url", "description", "all_categories",
    "price_level", "years_in_business", "facebook", "instagram", "twitter", "linkedin", "youtube", "tiktok", "attributes", "status",
    "reviews_sample", "latitude", "longitude", "date", "time",
]


def _text(c: Column, number: bool = False) -> Column:
    """The value as text; null gives an empty text, and so does the number 0."""
    shown = F.when(c != 0, c.cast("string")) if number else c.cast("string")
    return F.coalesce(shown, F.lit(""))


def sheet_rows(df: DataFrame, date: str, time: str) -> DataFrame:
    """Nested records as the 26 columns of a sheet row; a phone that a sheet would take for a formula gets an apostrophe."""
    c = F.col
    phone = _text(c("contact.phone"))
    attributes = [c(f"attributes.{k}") for k in ("amenities", "payments_accepted", "service_options", "highlights")]
    values = [
        _text(c("business_name")), F.when(phone.rlike("^[+=-]"), F.concat(F.lit("'"), phone)).otherwise(phone), _text(c("contact.email")),
        _text(c("contact.website")), _text(c("business_info.category")), _text(c("ratings.average_rating"), True),
        _text(c("ratings.total_reviews"), True), _text(c("address.full_address")), _text(c("google_maps_url")),
        _text(c("business_info.description")), F.concat_ws(", ", "business_info.all_categories"), _text(c("business_info.price_level")),
        _text(c("business_info.years_in_business")),
        *[_text(c(f"social_media.{p}")) for p in ("facebook", "instagram", "twitter", "linkedin", "youtube", "tiktok")],
        all_attributes(*attributes), _text(c("hours.current_status")), reviews_text(c("reviews_sample")),
        _text(c("coordinates.latitude"), True), _text(c("coordinates.longitude"), True), F.lit(date), F.lit(time),
    ]
    kept = [k for k in ("seq",) if k in df.columns]
    return df.select(*kept, *[v.alias(n) for n, v in zip(SHEET, values)])


def sheet_key(c: Column) -> Column:
    """A phone or URL as it is compared: without leading apostrophes and white space around; empty for none."""
    return F.coalesce(strip(F.ltrim(c, F.lit("'"))), F.lit(""))


def append_unique(rows: DataFrame, sheet: DataFrame, scratch: str) -> DataFrame:
    """The rows (seq, phone, maps_url, ...) to append to a sheet (phone, maps_url): those whose phone, else URL, is not yet there.

    Rows of one batch are compared in the order of `seq`, too: a row that stays registers its phone and URL, one that is
    dropped registers nothing.
    """
    keyed = rows.select("seq", sheet_key(F.col("phone")).alias("phone"), F.coalesce(strip(F.col("maps_url")), F.lit("")).alias("url"))
    for key, there in (("phone", sheet_key(F.col("phone"))), ("url", strip(F.col("maps_url")))):
        known = sheet.select(there.alias("__k")).where("__k <> ''").distinct()
        keyed = keyed.join(known, keyed[key] == known["__k"], "left_anti")
    return rows.join(greedy_dedup(keyed, ["phone", "url"], scratch).select("seq"), "seq", "left_semi")


def mark_sent(sheet: DataFrame, first: int, last: int, today: str) -> DataFrame:
    """A sheet (sheet_row, status, sent_date, ...) with the rows from first to last marked as sent."""
    inside = F.col("sheet_row").between(first, last)
    return sheet.withColumns({"status": F.when(inside, "SENT").otherwise(F.col("status")), "sent_date": F.when(inside, today).otherwise(F.col("sent_date"))})


def column_index(letters: Column) -> Column:
    """Column letters as a number from 0; null for no letters."""
    parts = F.transform(F.split(F.upper(letters), ""), lambda x: F.ascii(x) - 64)
    number = F.aggregate(parts, F.lit(0), lambda acc, x: acc * 26 + x) - 1
    return F.when(letters != "", number)


def a1_range(c: Column) -> Column:
    """start_row, end_row, start_col, end_col of a range as 'Sheet!A2:K10'; ends are exclusive, parts without both ends are 0."""
    part = F.coalesce(F.nullif(F.regexp_extract(c, "!([^!]*)", 1), F.lit("")), c)
    digits, letters = F.regexp_extract_all(part, F.lit(r"(\d+)"), F.lit(1)), F.regexp_extract_all(part, F.lit("([A-Z]+)"), F.lit(1))
    both = lambda found, value: F.when(F.size(found) >= 2, value).otherwise(0).cast("int")
    row, col = lambda i: F.get(digits, F.lit(i)).cast("int"), lambda i: column_index(F.get(letters, F.lit(i)))
    return F.struct(both(digits, row(0) - 1).alias("start_row"), both(digits, row(1)).alias("end_row"), both(letters, col(0)).alias("start_col"), both(letters, col(1) + 1).alias("end_col"))
