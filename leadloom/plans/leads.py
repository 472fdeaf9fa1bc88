"""The leads that queries run on, derived from customer, nation and region by one set of SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = {
    "seq": "c_custkey",
    "place_id": "CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'pl' || CAST(c_custkey - c_custkey % 4 + (c_custkey % 4) % 3 AS STRING) END",
    "business_name": "c_name",
    "maps_url": "'https://maps.example.com/place/' || CAST(c_custkey - c_custkey % 10 + (c_custkey % 10) % 9 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '?hl=en' ELSE '/' END",
    "city": "n_name",
    "country": "r_name",
    "phone": "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE '+971 4 ' || lpad(CAST(c_custkey - c_custkey % 6 + (c_custkey % 6) % 5 AS STRING), 7, '0') END",
    "website": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'https://www.site' || CAST(c_custkey % 50 AS STRING) || '.example.org/' END",
    "email": "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'logo@2x.png' WHEN c_custkey % 9 = 0 THEN 'x@sentry.io' ELSE 'Info' || CAST(c_custkey AS STRING) || '@Acme.AE' END",
    "instagram": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'https://www.instagram.com/acme' || CAST(c_custkey AS STRING) END",
    "facebook": "CASE WHEN c_custkey % 6 = 0 THEN 'https://www.facebook.com/acme' || CAST(c_custkey AS STRING) END",
    "category": "c_mktsegment",
    "categories": "c_mktsegment || '|' || CASE WHEN c_acctbal > 5000 THEN 'Premium' ELSE 'Standard' END",
    "description": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'Serving ' || n_name || ' since ' || CAST(1950 + c_custkey % 70 AS STRING) END",
    "average_rating": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST((c_custkey * 13) % 51 AS DOUBLE) / 10 END",
    "total_reviews": "CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 500 AS INT) END",
    "latitude": "CAST((c_custkey * 37) % 18000 AS DOUBLE) / 100 - 90",
    "longitude": "CAST((c_custkey * 91) % 36000 AS DOUBLE) / 100 - 180",
    "source_query": "c_mktsegment || ' in ' || r_name",
    "status": "CASE WHEN c_custkey % 14 = 0 THEN 'SENT' WHEN c_custkey % 15 = 0 THEN 'FAILED' ELSE '' END",
}
#: The same leads as a SQL table expression.
SQL = "leads AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leads, with `all_categories` as an array and null columns for the platforms that have no data."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    joined = customer.join(places, customer.c_nationkey == places.n_nationkey)
    rows = joined.selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])
    return rows.selectExpr("*", r"split(categories, '\\|') AS all_categories", *[f"CAST(NULL AS STRING) AS {p}" for p in ("twitter", "linkedin", "youtube", "tiktok")])
