"""Flat projections for export: named columns, generic flattening of nested records, pruning of empty columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADERS = {
    "business_name": "Business Name", "place_id": "Place ID", "google_maps_url": "Google Maps URL", "address.full_address": "Full Address",
    "address.street": "Street", "address.city": "City", "address.state": "State", "address.postal_code": "Zip", "address.country": "Country",
    "contact.phone": "Phone", "contact.website": "Website", "contact.email": "Email", "social_media.facebook": "Facebook",
    "social_media.instagram": "Instagram", "social_media.twitter": "Twitter", "social_media.linkedin": "LinkedIn",
    "social_media.youtube": "YouTube", "social_media.tiktok": "TikTok", "business_info.category": "Primary Category",
    "business_info.all_categories": "All Categories", "business_info.description": "Description", "ratings.average_rating": "Rating",
    "ratings.total_reviews": "Reviews", "metadata.query": "Query", "metadata.scraped_at": "Scraped At",
}


def flatten_business(df: DataFrame) -> DataFrame:
    """The 25 named columns of nested records; categories are joined by commas."""
    pick = lambda c: F.concat_ws(", ", F.col(c)) if c.endswith("all_categories") else F.col(c)
    return df.select(*[pick(c).alias(h) for c, h in HEADERS.items()])


def list_text(c: Column, of: T.DataType) -> Column:
    """A list as "['a', 'b']"; strings are quoted, other values are not; null for an empty list."""
    one = (lambda v: F.concat(F.lit("'"), v, F.lit("'"))) if isinstance(of, T.StringType) else (lambda v: v.cast("string") if not isinstance(of, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(v))
    return F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: F.coalesce(one(v), F.lit("None"))), ", "), F.lit("]")))


def flatten_generic(df: DataFrame) -> DataFrame:
    """Nested structs as columns a_b_c; lists as text; empty structs give no column."""

    def walk(fields, path: str, name: str):
        for f in fields:
            p, n = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}_{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, p, n)
            elif isinstance(f.dataType, T.ArrayType):
                yield list_text(F.col(p), f.dataType.elementType).alias(n)
            else:
                yield F.col(p).alias(n)

    return df.select(*walk(df.schema.fields, "", ""))


def prune_empty(df: DataFrame) -> DataFrame:
    """Without columns in which every value is null, NaN, blank, '[]', '{}' or 'None'.  One aggregate over the data."""
    def filled(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        text = F.trim(c.cast("string")) if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(c)
        return F.max(F.when(text.isNotNull() & ~text.isin("", "[]", "{}", "None", "NaN"), 1).otherwise(0))

    row = df.agg(*[filled(f).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]).first()
    return df.select(*[F.col(f"`{f.name}`") for i, f in enumerate(df.schema.fields) if row[f"c{i}"]])


#: Columns of a stored lead and where they come from; JSON marks those that are kept as JSON text.
STORED = {
    "place_id": "place_id", "name": "business_name", "full_address": "address.full_address", "city": "address.city", "state": "address.state",
    "postal_code": "address.postal_code", "country": "address.country", "phone": "contact.phone", "website": "contact.website",
    "email": "contact.email", "rating": "ratings.average_rating", "review_count": "ratings.total_reviews",
    "category": "business_info.category", "all_categories": "business_info.all_categories", "latitude": "coordinates.latitude",
    "longitude": "coordinates.longitude", "google_maps_url": "google_maps_url", "hours": "hours", "attributes": "attributes",
    "images": "images", "facebook": "social_media.facebook", "instagram": "social_media.instagram", "twitter": "social_media.twitter",
    "linkedin": "social_media.linkedin", "youtube": "social_media.youtube", "tiktok": "social_media.tiktok",
}
JSON = {"all_categories": "[]", "hours": "{}", "attributes": "{}", "images": "{}"}


def db_rows(df: DataFrame, source_query: str | None = None, scraped_at: Column | None = None) -> DataFrame:
    """Nested records as the 28 columns of a stored lead; lists and nested parts are JSON text, nulls in them included."""
    def column(name: str, path: str) -> Column:
        if name in JSON:
            empty = F.lit(JSON[name])
            return F.coalesce(F.to_json(path, {"ignoreNullFields": "false"}), empty)
        return F.nullif(F.col(path), F.lit("")) if name == "google_maps_url" else F.col(path)

    query = F.coalesce(F.nullif(F.lit(source_query), F.lit("")), F.col("metadata.query"))
    stamp = F.current_timestamp() if scraped_at is None else scraped_at
    return df.select(*[column(n, p).alias(n) for n, p in STORED.items()], query.alias("source_query"), stamp.alias("scraped_at"))


def lead_objects(rows: DataFrame) -> DataFrame:
    """Stored leads with their JSON columns as objects (variants); empty and missing ones become [] or {}."""
    parsed = {c: F.parse_json(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(empty))) for c, empty in JSON.items() if c in rows.columns}
    stamp = {"scraped_at": F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss")} if dict(rows.dtypes).get("scraped_at", "").startswith("timestamp") else {}
    return rows.withColumns(parsed | stamp)
