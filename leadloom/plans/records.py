"""Registered queries of exports, sheets, geocoding, grid states and run reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..functions.urls import normalize_url
from ..operators import dedup, flatten, geo, sheet, stats
from ..sources import dims
from .leads import SQL as LEADS
from .leads import leads
from .queries import CELLS_SQL, CITY, CITY_SQL, MARKED_SQL, ORACLE_SQL, boxes, marked_cells, nested, on_leads, query, read
from .scratch import scratch

# --- exports --------------------------------------------------------------------------------------------------------

JSON_SQL = """'["' || replace(categories, '|', '","') || '"]'"""
NO = "CAST(NULL AS VARCHAR)"


@on_leads("db_rows", f"""SELECT place_id, business_name AS name, city || ', ' || country AS full_address, city, {NO} AS state, {NO} AS postal_code, country, phone, website, email, average_rating AS rating,
    total_reviews AS review_count, category, {JSON_SQL} AS all_categories, latitude, longitude, maps_url AS google_maps_url, CASE WHEN seq % 3 = 0 THEN '{{"current_status":"Open"}}' ELSE '{{"current_status":null}}' END AS hours,
    '{{"amenities":["Wi-Fi"," Toilets"],"payments_accepted":["Wi-Fi"],"service_options":' || CASE WHEN seq % 2 = 0 THEN '["Delivery"]' ELSE 'null' END || ',"highlights":null}}' AS attributes,
    '{{"main_image_url":"https://img/' || seq || '","all_image_urls":[]}}' AS images, facebook, instagram, {NO} AS twitter, {NO} AS linkedin, {NO} AS youtube, {NO} AS tiktok, source_query, '2026-01-02' AS scraped_at FROM leads""")  # fmt: skip
def _(df):
    return flatten.db_rows(nested(df), scraped_at=F.lit("2026-01-02"))


@on_leads("lead_objects", "SELECT place_id, CAST(len(string_split(categories, '|')) AS INT) AS categories, string_split(categories, '|')[1] AS first_category, CASE WHEN seq % 3 = 0 THEN 'Open' END AS status, '[]' AS image_list FROM leads")
def _(df):
    rows = flatten.lead_objects(flatten.db_rows(nested(df), scraped_at=F.lit("2026-01-02")))
    get = F.try_variant_get
    return rows.select(
        "place_id", F.size(get("all_categories", "$", "array<string>")).alias("categories"), get("all_categories", "$[0]", "string").alias("first_category"),
        get("hours", "$.current_status", "string").alias("status"), F.to_json(get("images", "$.all_image_urls", "variant")).alias("image_list"),
    )


@on_leads("sheet_rows", """SELECT seq, business_name AS name, CASE WHEN phone LIKE '+%' THEN '''' || phone ELSE coalesce(phone, '') END AS phone, coalesce(email, '') AS email, coalesce(website, '') AS website, category,
    CASE WHEN coalesce(average_rating, 0) = 0 THEN '' ELSE CAST(average_rating AS VARCHAR) END AS rating, CASE WHEN coalesce(total_reviews, 0) = 0 THEN '' ELSE CAST(total_reviews AS VARCHAR) END AS reviews,
    city || ', ' || country AS full_address, maps_url, coalesce(description, '') AS description, replace(categories, '|', ', ') AS all_categories, CASE WHEN seq % 2 = 0 THEN '$$' ELSE '' END AS price_level, '' AS years_in_business,
    coalesce(facebook, '') AS facebook, coalesce(instagram, '') AS instagram, '' AS twitter, '' AS linkedin, '' AS youtube, '' AS tiktok, 'Wi-Fi, Toilets' || CASE WHEN seq % 2 = 0 THEN ', Delivery' ELSE '' END AS attributes,
    CASE WHEN seq % 3 = 0 THEN 'Open' ELSE '' END AS status, business_name || ' (' || seq % 5 || '★): Good [' || city || ']' AS reviews_sample, CASE WHEN latitude = 0 THEN '' ELSE CAST(latitude AS VARCHAR) END AS latitude,
    CASE WHEN longitude = 0 THEN '' ELSE CAST(longitude AS VARCHAR) END AS longitude, '2026-01-02' AS date, '03:04:05' AS time FROM leads""")  # fmt: skip
def _(df):
    return sheet.sheet_rows(nested(df), "2026-01-02", "03:04:05")


SHORT_URL = "[/?].?.?.?.?.?$"


@on_leads("append_unique")
def _(df):
    rows = df.select("seq", F.concat(F.lit("'"), F.coalesce("phone", F.lit(""))).alias("phone"), F.regexp_replace("maps_url", SHORT_URL, "").alias("maps_url"))
    return sheet.append_unique(rows.where("seq % 5 <> 0"), rows.where("seq % 5 = 0"), scratch(df.sparkSession)).select("seq")


ORACLE_SQL["append_unique"] = f"""
    WITH RECURSIVE {LEADS},
    r AS (SELECT seq, coalesce(phone, '') AS p, regexp_replace(maps_url, '{SHORT_URL}', '') AS u FROM leads),
    l AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM r WHERE seq % 5 <> 0 AND NOT (p <> '' AND p IN (SELECT p FROM r WHERE seq % 5 = 0)) AND u NOT IN (SELECT u FROM r WHERE seq % 5 = 0)),
    g AS (
        SELECT CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS seq, false AS kept, CAST([] AS VARCHAR[]) AS ps, CAST([] AS VARCHAR[]) AS us
        UNION ALL
        SELECT x.rn, x.seq, NOT x.d, CASE WHEN x.d OR x.p = '' THEN x.ps ELSE list_append(x.ps, x.p) END, CASE WHEN x.d THEN x.us ELSE list_append(x.us, x.u) END
        FROM (SELECT l.rn, l.seq, l.p, l.u, g.ps, g.us, (l.p <> '' AND list_contains(g.ps, l.p)) OR list_contains(g.us, l.u) AS d FROM g JOIN l ON l.rn = g.rn + 1) x
    )
    SELECT seq FROM g WHERE kept"""


@on_leads("mark_sent_rows", "SELECT seq + 1 AS sheet_row, CASE WHEN seq + 1 BETWEEN 20 AND 60 THEN 'SENT' ELSE status END AS status, CASE WHEN seq + 1 BETWEEN 20 AND 60 THEN '2026-01-02' ELSE '' END AS sent_date FROM leads")
def _(df):
    return sheet.mark_sent(df.select((F.col("seq") + 1).alias("sheet_row"), "status", F.lit("").alias("sent_date")), 20, 60, "2026-01-02")


@query("a1_ranges", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE p_partkey - 1 END AS start_row, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE p_partkey + 9 END AS end_row, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 26 ELSE 0 END AS start_col, CASE p_partkey % 3 WHEN 0 THEN 11 WHEN 1 THEN 55 ELSE 0 END AS end_col FROM part")
def _(spark, d):
    shown = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('Leads!B', p_partkey, ':K', p_partkey + 9) WHEN 1 THEN concat('AA', p_partkey, ':BC', p_partkey + 9) ELSE concat('C', p_partkey) END")
    r = sheet.a1_range(shown)
    return read(spark, d, "part").select("p_partkey", *[r[c].cast("long").alias(c) for c in ("start_row", "end_row", "start_col", "end_col")])


# --- joins ----------------------------------------------------------------------------------------------------------


@on_leads("before_visit", """, u AS (SELECT seq, city, place_id, regexp_replace(regexp_replace(maps_url, '[?#].*$', ''), '/+$', '') AS url FROM leads),
    d AS (SELECT city, url IN (SELECT url FROM u WHERE seq % 7 = 0) OR (place_id <> '' AND place_id IN (SELECT place_id FROM u WHERE seq % 11 = 0)) AS dup FROM u)
    SELECT city, count_if(NOT dup) AS to_visit, count_if(dup) AS duplicates_skipped FROM d GROUP BY city""")  # fmt: skip
def _(df):
    seen_urls = df.where("seq % 7 = 0").select(normalize_url(F.col("maps_url")).alias("id"))
    found = dedup.before_visit(df.select("city", F.col("maps_url").alias("url"), "place_id"), seen_urls, df.where("seq % 11 = 0").select(F.col("place_id").alias("id")))
    return found.groupBy("city").agg(F.count_if("visit").alias("to_visit"), F.sum("duplicate").alias("duplicates_skipped"))


CITY_VALUES = ", ".join("(" + repr(c[0]) + ", " + ", ".join(f"CAST({v} AS DOUBLE)" for v in c[1:]) + ")" for c in dims.CITIES)


@query("geocode_cascade", f"""
    WITH {LEADS}, p AS (SELECT seq, CASE WHEN seq % 5 < 2 THEN trim({CITY_SQL}) ELSE 'Place ' || seq % 40 END AS location, CASE seq % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Narnia' END AS country FROM leads),
    hit AS (SELECT s_suppkey AS n, 'Place ' || s_suppkey % 40 || CASE WHEN s_suppkey % 4 = 0 THEN ', Narnia' ELSE '' END AS query, CASE WHEN s_suppkey % 4 = 1 THEN 'de' ELSE '' END AS code, s_acctbal AS importance,
        CAST(s_suppkey % 80 AS DOUBLE) AS lat FROM supplier WHERE s_suppkey % 6 <> 0),
    best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY query, code ORDER BY importance DESC, n) AS rn FROM hit) WHERE rn = 1),
    cache AS (SELECT DISTINCT lower(location) || '|' || lower(coalesce(country, '')) AS key FROM p WHERE seq % 13 = 0),
    city(name, north, south, east, west) AS (VALUES {CITY_VALUES}),
    j AS (SELECT p.*, cache.key, city.name, city.north, a.n AS an, a.lat AS alat, a.importance AS aimp, b.n AS bn, b.lat AS blat, b.importance AS bimp
        FROM p LEFT JOIN cache ON cache.key = lower(location) || '|' || lower(coalesce(country, '')) LEFT JOIN city ON name = lower(location)
        LEFT JOIN best a ON a.query = location AND a.code = CASE WHEN country = 'Germany' THEN 'de' ELSE '' END LEFT JOIN best b ON b.query = location || ', ' || country AND b.code = '')
    SELECT seq, CASE WHEN key IS NOT NULL THEN 'cache' WHEN name IS NOT NULL THEN 'predefined' WHEN an IS NOT NULL THEN 'hit' WHEN bn IS NOT NULL THEN 'hit with country' ELSE 'none' END AS source,
        CASE WHEN key IS NOT NULL THEN 1.0 WHEN name IS NOT NULL THEN north WHEN an IS NOT NULL THEN alat + 1 ELSE blat + 1 END AS north,
        CASE WHEN key IS NOT NULL THEN 0.5 WHEN name IS NOT NULL THEN 1.0 WHEN an IS NOT NULL THEN aimp ELSE bimp END AS importance FROM j""")  # fmt: skip
def _(spark, d):
    place, country = F.expr(f"CASE WHEN seq % 5 < 2 THEN trim({CITY}) ELSE concat('Place ', seq % 40) END"), F.expr("CASE seq % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Narnia' END")
    places = leads(spark, d).select("seq", place.alias("location"), country.alias("country"))
    cache = places.where("seq % 13 = 0").select(F.concat(F.lower("location"), F.lit("|"), F.lower(F.coalesce("country", F.lit("")))).alias("key")).distinct()
    cache = cache.select("key", *[F.lit(1.0).alias(c) for c in ("north", "south", "east", "west")], F.lit(0.5).alias("importance"))
    hits = read(spark, d, "supplier").selectExpr(
        "s_suppkey AS n", "concat('Place ', s_suppkey % 40, CASE WHEN s_suppkey % 4 = 0 THEN ', Narnia' ELSE '' END) AS query", "CASE WHEN s_suppkey % 4 = 1 THEN 'de' ELSE '' END AS code", "s_acctbal AS importance",
        "CASE WHEN s_suppkey % 6 = 0 THEN array('1') ELSE array(cast(s_suppkey % 80 as string), cast(s_suppkey % 80 + 1.0 as string), '3', '4') END AS boundingbox",
    )
    return dims.geocode(places, cache, hits).select("seq", "source", "north", "importance")


# --- grid states ----------------------------------------------------------------------------------------------------


@query("grid_shape", f"WITH {CELLS_SQL} SELECT id, CAST(max(row) + 1 AS INT) AS rows, CAST(max(col) + 1 AS INT) AS cols, count(*) AS total_cells FROM cells GROUP BY id")
def _(spark, d):
    return geo.grid_shape(geo.grid_cells(boxes(spark, d), 2.0), "id")


@query("grid_search_urls", f"WITH {CELLS_SQL} SELECT id, cell_id, 'https://maps.example.com/search/bars+%26+cafes+in+' || id || '/@' || lat || ',' || lng || ',14z' AS url FROM cells")
def _(spark, d):
    return geo.grid_cells(boxes(spark, d), 2.0).select("id", "cell_id", geo.grid_search_url(F.concat(F.lit("bars & cafes in "), "id"), "https://maps.example.com/search").alias("url"))


@query("mark_cells", f"WITH {MARKED_SQL} SELECT id, cell_id, (is_scraped OR n % 4 = 0 OR n % 6 = 1) AS is_scraped, (is_empty OR n % 6 = 1) AS is_empty, CASE WHEN n % 4 = 0 THEN n % 9 ELSE result_count END AS result_count FROM marked")
def _(spark, d):
    parts = geo.cell_parts(boxes(spark, d), 2.0)
    cells = marked_cells(spark, d, parts)
    n = F.col("row") * 7 + F.col("col") * 3 + F.col("id")
    results = cells.where(n % 4 == 0).select("id", "cell_id", (n % 9).cast("int").alias("result_count"))
    checks = cells.where(n % 2 == 1).select("id", "cell_id", (n % 6 != 1).alias("is_populated"))
    return geo.mark_empty(geo.mark_scraped(cells, results, "id", parts=parts), checks, "id", parts=parts).select("id", "cell_id", "is_scraped", "is_empty", "result_count")


@query("grid_json_round_trip", f"WITH {MARKED_SQL} SELECT id, cell_id, row, col, lat, lng, is_scraped, is_empty, CAST(result_count AS INT) AS result_count FROM marked")
def _(spark, d):
    grids = geo.grid_json(boxes(spark, d), marked_cells(spark, d), 2.0)
    return geo.cells_of_json(grids).select("id", "cell_id", "row", "col", "lat", "lng", "is_scraped", "is_empty", "result_count")


# --- reports --------------------------------------------------------------------------------------------------------


@query("filter_stats", "SELECT s_nationkey, count(*) AS total_cells, count_if(s_suppkey % 4 <> 0) AS populated_cells, count_if(s_suppkey % 4 = 0) AS empty_cells, round(count_if(s_suppkey % 4 = 0) / count(*) * 100, 1) AS skip_pct, count_if(s_suppkey % 4 = 0) * 30 AS seconds_saved FROM supplier GROUP BY s_nationkey")
def _(spark, d):
    return stats.filter_stats(read(spark, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 4 != 0).alias("is_populated")), "s_nationkey")


@query("preview_sample", """WITH n AS (SELECT count(*) AS n, greatest(1, count(*) // 20) AS step FROM part), r AS (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part),
    s AS (SELECT p_size FROM r, n WHERE i % step = 0 AND i / step < 20)
    SELECT count(*) AS sampled, count_if(p_size % 5 = 0) AS empty, CAST(floor(count_if(p_size % 5 = 0) / count(*) * (SELECT n FROM n)) AS BIGINT) AS estimated_empty FROM s""")  # fmt: skip
def _(spark, d):
    return stats.preview(read(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 != 0).alias("is_populated")), "p_partkey", 20)


RUNS = [
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'a_with' WHEN 'MACHINERY' THEN 'b_without' ELSE 'c_other' END AS config", "CAST(c_custkey % 11 AS DOUBLE) / 10 AS pass_rate",
    "CAST(c_custkey % 97 AS DOUBLE) + 0.25 AS time_seconds", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 1000 END AS tokens",
]
LONG_RUNS = f"r AS (SELECT {', '.join(RUNS)} FROM customer), l AS (SELECT config, 'pass_rate' AS metric, pass_rate AS v FROM r UNION ALL SELECT config, 'time_seconds', time_seconds FROM r UNION ALL SELECT config, 'tokens', CAST(coalesce(tokens, 0) AS DOUBLE) FROM r)"


@query("run_summary", f"WITH {LONG_RUNS} SELECT config, metric, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS stddev, round(min(v), 4) AS min, round(max(v), 4) AS max FROM l GROUP BY config, metric")
def _(spark, d):
    return stats.run_summary(read(spark, d, "customer").selectExpr(*RUNS))


@query("run_delta", f"WITH {LONG_RUNS}, m AS (SELECT metric, round(avg(v) FILTER (config = 'a_with'), 4) - round(avg(v) FILTER (config = 'b_without'), 4) AS d FROM l GROUP BY metric) SELECT metric, CASE metric WHEN 'pass_rate' THEN printf('%+.2f', d) WHEN 'time_seconds' THEN printf('%+.1f', d) ELSE printf('%+.0f', d) END AS delta FROM m")
def _(spark, d):
    return stats.run_delta(stats.run_summary(read(spark, d, "customer").selectExpr(*RUNS)))


@query("run_results", """SELECT o_orderkey AS eval_id, CASE WHEN o_orderkey % 2 = 0 THEN 'with' ELSE 'without' END AS config, CAST(o_orderkey % 7 AS INT) AS run_number, CASE WHEN o_orderkey % 5 = 1 THEN 0.0 ELSE CAST(o_orderkey % 5 AS DOUBLE) / 4 END AS pass_rate,
    CASE WHEN o_orderkey % 5 = 1 THEN 0 ELSE o_orderkey % 5 END AS passed, CASE WHEN o_orderkey % 3 = 0 THEN 12.5 WHEN o_orderkey % 3 = 1 THEN 3.5 ELSE 0.0 END AS time_seconds,
    CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 10 <> 0 THEN o_orderkey % 10 ELSE 77 END AS tokens, CAST(1 AS INT) AS notes FROM orders WHERE o_orderkey % 9 <> 0""")  # fmt: skip
def _(spark, d):
    graded = read(spark, d, "orders").selectExpr(
        "concat('/x/runs/eval-', o_orderkey, '/', CASE WHEN o_orderkey % 2 = 0 THEN 'with' ELSE 'without' END, '/run-', o_orderkey % 7, '/grading.json') AS path",
        """CASE WHEN o_orderkey % 9 = 0 THEN '{broken' ELSE concat('{', CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE concat('"summary":{"pass_rate":', cast(o_orderkey % 5 as double) / 4, ',"passed":', o_orderkey % 5, '},') END,
            CASE WHEN o_orderkey % 3 = 0 THEN '"timing":{"total_duration_seconds":12.5},' ELSE '' END, '"execution_metrics":{"output_chars":77},"user_notes_summary":{"needs_review":["a"]}}') END AS grading""",
        """CASE WHEN o_orderkey % 3 <> 2 THEN concat('{"total_duration_seconds":3.5,"total_tokens":', o_orderkey % 10, '}') END AS timing""",
    )
    return stats.run_results(graded).select("eval_id", "config", "run_number", "pass_rate", "passed", "time_seconds", "tokens", F.size("notes").alias("notes"))


@query("correct_runs", "SELECT s_nationkey, CAST(sum(CASE WHEN s_suppkey % 3 = 0 THEN 5 - s_suppkey % 5 ELSE s_suppkey % 5 END) AS BIGINT) AS correct, count(*) * 5 AS total FROM supplier GROUP BY s_nationkey")
def _(spark, d):
    rows = read(spark, d, "supplier").selectExpr("s_nationkey", "CASE WHEN s_suppkey % 3 = 0 THEN false WHEN s_suppkey % 2 = 0 THEN true END AS should_trigger", "s_suppkey % 5 AS triggers", "5 AS runs")
    return stats.correct_runs(rows, "s_nationkey")


@query("run_outcomes", """SELECT user_id, count_if(event_type = 'purchase') AS scraped, count_if(event_type = 'error') AS failed, count_if(event_type = 'signup') AS retried, count_if(event_type = 'view') AS restarts, count_if(event_type = 'click') AS breaks,
    round(coalesce(count_if(event_type = 'purchase') / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 0), 0), 1) AS per_hour FROM events GROUP BY user_id""")  # fmt: skip
def _(spark, d):
    names = {"purchase": "scraped", "error": "failed", "signup": "retried", "view": "restart", "click": "break"}
    outcome = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    return stats.run_counters(read(spark, d, "events").select("user_id", outcome.alias("outcome"), F.col("ts").cast("timestamp").alias("at")), "user_id")


@on_leads("rating_histogram", "SELECT CAST(CASE WHEN average_rating >= 5 THEN 6 ELSE floor(average_rating) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM leads GROUP BY 1")
def _(df):
    return df.groupBy(F.width_bucket("average_rating", F.lit(0.0), F.lit(5.0), F.lit(5)).alias("bucket")).agg(F.count("*").alias("n"))


# --- lists ----------------------------------------------------------------------------------------------------------


@on_leads("longest_candidate", "SELECT seq, CASE WHEN seq % 4 = 0 THEN NULL ELSE 'We have served the people of ' || city || ' since ' || CAST(1900 + seq % 100 AS VARCHAR) END AS description FROM leads")
def _(df):
    long = F.expr("CASE WHEN seq % 4 = 0 THEN NULL ELSE concat('We have served the people of ', city, ' since ', 1900 + seq % 100) END")
    texts = F.array(F.lit("Open"), F.lit("A short line with words"), F.lit("4.5 stars from a very great number of happy people in town"), F.concat(F.lit("  "), long), F.lit("Averyveryverylongwordwithoutanyspacesinside"))
    return df.select("seq", fields.longest_candidate(F.filter(texts, lambda t: t.isNotNull())).alias("description"))


@on_leads("link_union", "SELECT seq, CASE WHEN seq % 3 = 0 THEN '/contact,/about' WHEN seq % 3 = 1 THEN '/team' || seq || ',/contact,/about' ELSE '/about,/contact' END AS links, CASE WHEN seq % 3 = 1 THEN '/team' || seq || ',/contact' WHEN seq % 3 = 2 THEN '/about,/contact' ELSE '/contact,/about' END AS first_links FROM leads")
def _(df):
    found = F.expr("CASE seq % 3 WHEN 1 THEN array(concat('/team', seq), '/contact') WHEN 2 THEN array('/about', '/about') END")
    links = fields.link_union(found, F.array(F.lit("/contact"), F.lit("/about")))
    return df.select("seq", F.array_join(links, ",").alias("links"), F.array_join(fields.first_of(links, 2), ",").alias("first_links"))


@on_leads("strip_prefix", "SELECT seq, city AS address, phone FROM leads")
def _(df):
    shown = lambda name, c: F.concat(F.lit(name), F.when(F.col("seq") % 2 == 0, ":  ").otherwise(": "), c)
    return df.select("seq", fields.strip_prefix(shown("Address", F.col("city")), "address").alias("address"), fields.strip_prefix(shown("PHONE", F.col("phone")), "phone").alias("phone"))
