"""Registered queries of the engine's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, text, urls
from ..operators import dedup, geo, rules, stats
from ..operators.rules import FilterConfig, query_leads
from ..sources import dims
from .leads import SQL as LEADS
from .leads import leads, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def on_leads(name: str, sql: str | None = None):
    """A query of f(leads); its SQL may use the table `leads`."""

    def put(f):
        QUERIES[name] = lambda spark, d: f(leads(spark, d))
        if sql:
            ORACLE_SQL[name] = f"WITH {LEADS} {sql}" if not sql.lstrip().startswith(",") else f"WITH {LEADS}{sql}"
        return f

    return put


# --- filter engine --------------------------------------------------------------------------------------------------

FLAT = ["seq", "place_id", "business_name", "city", "country", "phone", "website", "email", "average_rating", "total_reviews"]
FIRST = ", kept AS (SELECT * FROM leads WHERE place_id = '' UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY seq) AS rn FROM leads WHERE place_id <> '') WHERE rn = 1)"
COLS = ", ".join(FLAT)


def _filter(name: str, cfg: FilterConfig, where: str) -> None:
    @on_leads(name, f"{FIRST} SELECT {COLS} FROM kept WHERE {where}")
    def run(df: DataFrame) -> DataFrame:
        return rules.filter_leads(df, cfg).select(FLAT)


_filter("filter_and_dedup", FilterConfig(phone=True, min_rating=4.0), "phone <> '' AND average_rating >= 4.0")
_filter("filter_contact", FilterConfig(phone=True, website=True, email=True), "phone <> '' AND website <> '' AND email <> ''")
_filter("filter_quality", FilterConfig(min_rating=3.5, min_reviews=100), "average_rating >= 3.5 AND total_reviews >= 100")
_filter("filter_category_whitelist", FilterConfig(whitelist=["premium", "BUILDING"]), "categories LIKE '%Premium' OR category = 'BUILDING'")
_filter("filter_category_blacklist", FilterConfig(blacklist=["standard", "machinery"]), "NOT (categories LIKE '%Standard' OR category = 'MACHINERY')")
_filter("filter_keywords", FilterConfig(keywords=["since 19", "china"]), "contains(lower(business_name || ' ' || coalesce(description, '')), 'since 19') OR contains(lower(business_name || ' ' || coalesce(description, '')), 'china')")
_filter("filter_social_and", FilterConfig(socials=["facebook", "instagram"]), "facebook <> '' AND instagram <> ''")
_filter("filter_social_or", FilterConfig(socials=["facebook", "unknown", "tiktok"], social_logic="OR"), "facebook <> ''")
_filter("filter_global_or", FilterConfig(phone=True, min_rating=4.5, socials=["facebook"], logic="OR"), "coalesce(phone, '') <> '' OR average_rating >= 4.5 OR facebook <> ''")
_filter("filter_none", FilterConfig(), "true")


@on_leads("filter_without_dedup", f"SELECT {COLS} FROM leads WHERE phone <> '' AND total_reviews >= 250")
def _(df):
    return rules.filter_leads(df, FilterConfig(phone=True, min_reviews=250, dedup=False)).select(FLAT)


@on_leads("unsent_leads", "SELECT seq, email, status, seq + 1 AS sheet_row FROM leads WHERE trim(coalesce(email, '')) <> '' AND trim(coalesce(status, '')) = ''")
def _(df):
    return rules.unsent(df).select("seq", "email", "status", (F.col("seq") + 1).alias("sheet_row"))


KEY_SQL = "lower(trim(ltrim(coalesce({0}, ''), '''')))"
VALID_SQL = f"({KEY_SQL} NOT IN ('', '—', '-', 'n/a', 'none', 'null', 'undefined') AND length({KEY_SQL}) > 2)"


@on_leads("valid_keys", f"SELECT seq, {VALID_SQL.format('phone')} AS phone_ok, {VALID_SQL.format('status')} AS status_ok FROM leads")
def _(df):
    return df.select("seq", rules.is_valid_key(F.col("phone")).alias("phone_ok"), rules.is_valid_key(F.col("status")).alias("status_ok"))


@on_leads("sent_status_any_cell", "SELECT seq, upper(business_name || coalesce(description, '') || status) LIKE '%SENT%' AS sent FROM leads")
def _(df):
    return df.select("seq", rules.is_sent(F.col("business_name"), F.col("description"), F.col("status")).alias("sent"))


@on_leads("clean_phone", f"SELECT seq, CASE WHEN {VALID_SQL.format('p')} THEN trim(ltrim(p, '''')) ELSE '' END AS phone FROM (SELECT seq, '''' || phone || ' ' AS p FROM leads)")
def _(df):
    return df.select("seq", rules.clean_phone(F.concat(F.lit("'"), "phone", F.lit(" "))).alias("phone"))


# --- counts and retrieval -------------------------------------------------------------------------------------------


@on_leads("count_leads", "SELECT count(*) AS n FROM leads")
def _(df):
    return df.agg(F.count("*").alias("n"))


@on_leads("discover_categories", "SELECT DISTINCT c AS category FROM (SELECT unnest(string_split(categories, '|')) AS c FROM leads UNION ALL SELECT category FROM leads) WHERE c <> ''")
def _(df):
    return df.select(F.explode(F.array_append("all_categories", F.col("category"))).alias("category")).where("category <> ''").distinct().orderBy("category")


@on_leads("distinct_urls_for_query", "SELECT DISTINCT maps_url FROM leads WHERE source_query = 'BUILDING in ASIA' AND maps_url <> ''")
def _(df):
    return df.where("source_query = 'BUILDING in ASIA' and maps_url <> ''").select("maps_url").distinct()


@on_leads("distinct_place_ids_for_query", "SELECT DISTINCT place_id FROM leads WHERE source_query = 'BUILDING in ASIA' AND place_id <> ''")
def _(df):
    return df.where("source_query = 'BUILDING in ASIA' and place_id <> ''").select("place_id").distinct()


@on_leads("query_leads_city", f"SELECT {COLS} FROM leads WHERE city ILIKE '%nation_1%'")
def _(df):
    return query_leads(df, city="nation_1").select(FLAT)


@on_leads("query_leads_combined", f"SELECT {COLS} FROM leads WHERE category ILIKE '%build%' AND average_rating >= 2.5 AND email <> '' AND phone <> ''")
def _(df):
    return query_leads(df, category="build", min_rating=2.5, has_email=True, has_phone=True).select(FLAT)


@on_leads("query_leads_missing_email", f"SELECT {COLS} FROM leads WHERE coalesce(email, '') = ''")
def _(df):
    return query_leads(df, has_email=False).select(FLAT)


@on_leads("query_leads_page", f"SELECT {COLS} FROM leads WHERE average_rating >= 3 ORDER BY place_id, seq LIMIT 50 OFFSET 100")
def _(df):
    return query_leads(df, min_rating=3.0, limit=50, offset=100).select(FLAT)


@on_leads("leads_by_city", "SELECT city, category, count(*) AS n, round(avg(CASE WHEN coalesce(email, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS email_rate FROM leads GROUP BY city, category")
def _(df):
    return df.groupBy("city", "category").agg(F.count("*").alias("n"), F.round(F.avg(text.present(F.col("email")).cast("double")), 6).alias("email_rate"))


# --- dedup, upsert, joins -------------------------------------------------------------------------------------------


@on_leads("dedup_keep_first", f"{FIRST} SELECT seq, place_id FROM kept")
def _(df):
    return dedup.keep_first(df, "place_id", "seq").select("seq", "place_id")


@query("upsert_last_wins", "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(spark, d):
    return dedup.last_wins(read(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")


@on_leads("upsert_into_existing", ", a AS (SELECT * FROM leads WHERE seq % 3 = 0 AND place_id <> ''), b AS (SELECT * FROM leads WHERE seq % 3 <> 0 AND place_id <> ''), old AS (SELECT place_id, max(seq) AS seq FROM a GROUP BY 1), new AS (SELECT place_id, max(seq) AS seq FROM b GROUP BY 1) SELECT l.seq, l.place_id, l.phone FROM leads l JOIN (SELECT seq FROM new UNION ALL SELECT seq FROM old WHERE place_id NOT IN (SELECT place_id FROM new)) USING (seq)")
def _(df):
    some = df.select("seq", "place_id", "phone")
    stored = dedup.last_wins(some.where("seq % 3 = 0"), "place_id", "seq")
    return dedup.upsert(stored, some.where("seq % 3 <> 0"), "place_id", "seq")


@on_leads("anti_join_seen", "SELECT seq, maps_url FROM leads WHERE maps_url NOT IN (SELECT maps_url FROM leads WHERE seq % 4 = 0)")
def _(df):
    return dedup.unseen(df, df.where("seq % 4 = 0").select(F.col("maps_url").alias("id")), "maps_url").select("seq", "maps_url")


@on_leads("anti_join_two_keys", ", seen AS (SELECT maps_url AS id FROM leads WHERE seq % 9 = 0 UNION SELECT place_id FROM leads WHERE seq % 9 = 1) SELECT seq, maps_url, place_id FROM leads WHERE maps_url NOT IN (SELECT id FROM seen) AND place_id NOT IN (SELECT id FROM seen)")
def _(df):
    seen = df.where("seq % 9 = 0").select(F.col("maps_url").alias("id")).union(df.where("seq % 9 = 1").select("place_id")).distinct()
    return dedup.unseen(df, seen, "maps_url", "place_id").select("seq", "maps_url", "place_id")


@on_leads("seen_identifiers", "SELECT DISTINCT id FROM (SELECT phone AS id FROM leads UNION ALL SELECT maps_url FROM leads UNION ALL SELECT place_id FROM leads) WHERE id <> ''")
def _(df):
    ids = df.select(F.col("phone").alias("id")).union(df.select("maps_url")).union(df.select("place_id"))
    return ids.where("id <> ''").distinct()


@on_leads("secondary_duplicates", ", k AS (SELECT seq, place_id, phone AS v, 'p' AS t FROM leads WHERE phone <> '' UNION ALL SELECT seq, place_id, website, 'w' FROM leads WHERE website <> ''), m AS (SELECT DISTINCT a.seq, a.place_id, b.place_id AS other_id FROM k a JOIN k b ON a.v = b.v AND a.t = b.t WHERE a.place_id <> b.place_id AND a.place_id <> '' AND b.place_id <> '') SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seq ORDER BY other_id) AS INT) AS n FROM m) WHERE n <= 3")
def _(df):
    return dedup.secondary_duplicates(df)


@on_leads("greedy_multi_key_dedup")
def _(df):
    from .scratch import scratch

    keys = df.select("seq", F.coalesce("phone", F.lit("")).alias("phone"), urls.normalize_url(F.col("maps_url")).alias("url"))
    return dedup.greedy_dedup(keys, ["phone", "url"], scratch(df.sparkSession)).select("seq")


ORACLE_SQL["greedy_multi_key_dedup"] = f"""
    WITH RECURSIVE {LEADS},
    l AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn, coalesce(phone, '') AS p, regexp_replace(regexp_replace(maps_url, '[?#].*$', ''), '/+$', '') AS u FROM leads),
    g AS (
        SELECT CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS seq, false AS kept, CAST([] AS VARCHAR[]) AS ps, CAST([] AS VARCHAR[]) AS us
        UNION ALL
        SELECT x.rn, x.seq, NOT x.d, CASE WHEN x.d OR x.p = '' THEN x.ps ELSE list_append(x.ps, x.p) END, CASE WHEN x.d THEN x.us ELSE list_append(x.us, x.u) END
        FROM (SELECT l.rn, l.seq, l.p, l.u, g.ps, g.us, (l.p <> '' AND list_contains(g.ps, l.p)) OR list_contains(g.us, l.u) AS d FROM g JOIN l ON l.rn = g.rn + 1) x
    )
    SELECT seq FROM g WHERE kept"""


@on_leads("clean_sheet_dedup")
def _(df):
    from .scratch import scratch

    key = lambda c: F.when(rules.is_valid_key(c), text.strip(c)).otherwise("")
    sheet = df.select("seq", key(F.col("business_name")).alias("name"), rules.clean_phone(F.col("phone")).alias("phone"), key(urls.normalize_url(F.col("maps_url"))).alias("url"), rules.is_sent(F.col("status")).alias("sent"))
    return dedup.clean_sheet(sheet, scratch(df.sparkSession))


ORACLE_SQL["clean_sheet_dedup"] = f"""
    WITH RECURSIVE {LEADS},
    l AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn, business_name AS n, coalesce(phone, '') AS p, regexp_replace(regexp_replace(maps_url, '[?#].*$', ''), '/+$', '') AS u, contains(status, 'SENT') AS sent FROM leads),
    g AS (
        SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS ns, CAST([] AS VARCHAR[]) AS ps, CAST([] AS VARCHAR[]) AS us, CAST([] AS STRUCT(place BIGINT, seq BIGINT, n VARCHAR, p VARCHAR, u VARCHAR)[]) AS rows
        UNION ALL
        SELECT rn, CASE WHEN d OR n = '' THEN ns ELSE list_append(ns, n) END, CASE WHEN d OR p = '' THEN ps ELSE list_append(ps, p) END, CASE WHEN d OR u = '' THEN us ELSE list_append(us, u) END,
            CASE WHEN NOT d THEN list_append(rows, {{place: seq, seq: seq, n: n, p: p, u: u}})
                WHEN sent AND i IS NOT NULL THEN list_concat(list_concat(rows[:i - 1], [{{place: rows[i].place, seq: seq, n: n, p: p, u: u}}]), rows[i + 1:]) ELSE rows END
        FROM (SELECT l.*, g.ns, g.ps, g.us, g.rows, (u <> '' AND list_contains(us, u)) OR (p <> '' AND list_contains(ps, p)) OR (p = '' AND u = '' AND n <> '' AND list_contains(ns, n)) AS d,
                list_position([(u <> '' AND r.u = u) OR (p <> '' AND r.p = p) OR (n <> '' AND r.n = n) FOR r IN rows], true) AS i
            FROM g JOIN l ON l.rn = g.rn + 1))
    SELECT r.place, r.seq FROM (SELECT unnest(rows) AS r FROM g WHERE rn = (SELECT count(*) FROM l))"""


@query("train_test_membership", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS in_test FROM orders")
def _(spark, d):
    rich = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    both = orders.join(rich, "o_custkey", "left_semi").withColumn("in_test", F.lit(True)).unionByName(orders.join(rich, "o_custkey", "left_anti").withColumn("in_test", F.lit(False)))
    return both.select("o_orderkey", "in_test")


@query("feedback_full_join", "SELECT coalesce(c_custkey, o_custkey) AS run_id, c_acctbal AS balance, n FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(spark, d):
    n = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, d, "customer")
    return c.join(n, c.c_custkey == n.o_custkey, "full").select(F.coalesce("c_custkey", "o_custkey").alias("run_id"), F.col("c_acctbal").alias("balance"), "n")


# --- scalar functions -----------------------------------------------------------------------------------------------


@on_leads("validate_phone", r"SELECT seq, CASE WHEN regexp_matches(trim(p), '(?i)^\+?[\d\s\-\(\)\.ext]{7,25}$') THEN trim(p) END AS phone FROM (SELECT seq, CASE WHEN seq % 6 = 1 THEN business_name ELSE ' ' || phone END AS p FROM leads)")
def _(df):
    return df.select("seq", text.validate_phone(F.when(F.col("seq") % 6 == 1, F.col("business_name")).otherwise(F.concat(F.lit(" "), "phone"))).alias("phone"))


def _junk(e: str) -> str:
    tlds = ", ".join(f"'{t}'" for t in text.BLOCKED_TLDS)
    junk = " OR ".join(f"{e} LIKE '%@{j}' OR {e} LIKE '%.{j}'" for j in text.JUNK_DOMAINS)
    return f"regexp_extract({e}, '\\.([^.]*)$', 1) NOT IN ({tlds}) AND NOT ({junk})"


@on_leads("validate_email", rf"SELECT seq, CASE WHEN regexp_matches(e, '^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}$') AND length(e) <= 254 AND {_junk('e')} THEN e END AS email FROM (SELECT seq, lower(trim(email)) AS e FROM leads)")
def _(df):
    return df.select("seq", text.validate_email(F.col("email")).alias("email"))


SITES = " OR ".join(f"h = '{s}' OR h LIKE '%.{s}'" for s in urls.SOCIAL_SITES)


@on_leads("validate_url_reject_social", rf"SELECT seq, CASE WHEN u <> 'https://' AND NOT ({SITES}) THEN u END AS url FROM (SELECT seq, u, ltrim(lower(regexp_extract(u, '^https?://([^/?#]*)', 1)), 'w.') AS h FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN 'https://' || city || '.example.org/x' WHEN seq % 3 = 1 THEN website ELSE coalesce(instagram, 'https://') END AS u FROM leads))")
def _(df):
    raw = F.when(F.col("seq") % 3 == 0, F.concat("city", F.lit(".example.org/x"))).when(F.col("seq") % 3 == 1, F.col("website")).otherwise(F.coalesce("instagram", F.lit("")))
    return df.select("seq", urls.validate_url(raw, reject_social=True).alias("url"))


@on_leads("validate_rating", "SELECT seq, CASE WHEN r BETWEEN 0 AND 5 THEN round_even(r, 1) END AS rating FROM (SELECT seq, average_rating * 1.25 + 0.0125 AS r FROM leads)")
def _(df):
    return df.select("seq", text.validate_rating(F.col("average_rating") * 1.25 + 0.0125).alias("rating"))


@on_leads("validate_coordinates", "SELECT seq, CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN lat END AS lat, CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN lng END AS lng FROM (SELECT seq, latitude * 1.1 AS lat, longitude AS lng FROM leads)")
def _(df):
    c = urls.validate_coordinates(F.col("latitude") * 1.1, F.col("longitude"))
    return df.select("seq", c["lat"].alias("lat"), c["lng"].alias("lng"))


@on_leads("parse_rating_text", r"SELECT seq, CASE WHEN v <= 5 THEN round_even(v, 1) END AS rating FROM (SELECT seq, CAST(nullif(regexp_extract(translate(CAST(average_rating AS VARCHAR) || ' stars', ',', '.'), '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS v FROM leads)")
def _(df):
    return df.select("seq", text.parse_rating_text(F.translate(F.concat(F.col("average_rating").cast("string"), F.lit(" stars")), ".", ",")).alias("rating"))


@on_leads("parse_review_count", "SELECT seq, CASE WHEN seq % 3 = 2 THEN NULL ELSE CAST(total_reviews AS BIGINT) END AS reviews FROM leads")
def _(df):
    n = F.col("total_reviews").cast("string")
    shown = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("4.7 stars, "), n, F.lit(" Reviews"))).when(F.col("seq") % 3 == 1, F.concat(F.lit("("), n, F.lit(")"))).otherwise(F.concat(n, F.lit("K")))
    return df.select("seq", text.parse_review_count(shown).alias("reviews"))


DURATION = """CASE WHEN t < 60 THEN t || 's' WHEN t // 31104000 > 0 THEN (t // 31104000) || 'yr ' || (t // 2592000 % 12) || 'mo ' || (t // 86400 % 30) || 'd ' || hm
    WHEN t // 2592000 > 0 THEN (t // 2592000) || 'mo ' || (t // 86400 % 30) || 'd ' || hm WHEN t // 604800 > 0 THEN (t // 604800) || 'w ' || (t // 86400 % 7) || 'd ' || hm
    WHEN t // 86400 > 0 THEN (t // 86400) || 'd ' || hm WHEN t >= 3600 THEN hm ELSE (t // 60) || 'm' END"""


@query("format_duration", f"SELECT o_orderkey, {DURATION} AS duration FROM (SELECT o_orderkey, t, (t // 3600 % 24) || 'h ' || (t // 60 % 60) || 'm' AS hm FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 100 WHEN 1 THEN o_orderkey * 7 % 90000 WHEN 2 THEN o_orderkey * 1013 % 40000000 ELSE o_orderkey * 97 % 3000000 END AS t FROM orders))")
def _(spark, d):
    t = F.expr("CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 100 WHEN 1 THEN o_orderkey * 7 % 90000 WHEN 2 THEN o_orderkey * 1013 % 40000000 ELSE o_orderkey * 97 % 3000000 END")
    return read(spark, d, "orders").select("o_orderkey", text.format_duration(t).alias("duration"))


@on_leads("sanitize_filename", r"""SELECT seq, left(trim(regexp_replace(regexp_replace(maps_url || '<' || city || '>', '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '_+', '_', 'g'), '_'), 80) AS name FROM leads""")
def _(df):
    return df.select("seq", text.sanitize_filename(F.concat("maps_url", F.lit("<"), "city", F.lit(">"))).alias("name"))


@query("normalize_url", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''), '([^/:])/+$', '\\1') AS url FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@on_leads("extract_location", r"SELECT seq, nullif(trim(regexp_extract(trim(CASE WHEN seq % 7 = 0 THEN category ELSE source_query END), '(?i)\bin\s+(.+)$', 1)), '') AS location FROM leads")
def _(df):
    return df.select("seq", text.location_of_query(F.when(F.col("seq") % 7 == 0, F.col("category")).otherwise(F.col("source_query"))).alias("location"))


@on_leads("resolve_query", "SELECT seq, coalesce(trim(nullif(CASE WHEN seq % 3 = 0 THEN source_query ELSE '' END, '')), trim(category) || ' in ' || trim(CASE WHEN seq % 2 = 0 THEN city END), trim(category)) AS q FROM leads")
def _(df):
    q = F.when(F.col("seq") % 3 == 0, F.col("source_query")).otherwise("")
    return df.select("seq", text.resolve_query(q, F.col("category"), F.when(F.col("seq") % 2 == 0, F.col("city"))).alias("q"))


@on_leads("parse_bounds", "SELECT seq, latitude + 1 AS north, latitude - 1 AS south, longitude + 1 AS east, longitude - 1 AS west FROM leads")
def _(df):
    shown = F.concat_ws(" , ", *[(F.col(c) + v).cast("string") for c, v in (("latitude", 1), ("latitude", -1), ("longitude", 1), ("longitude", -1))])
    return df.select("seq", geo.parse_bounds(shown).alias("b")).select("seq", "b.*")


SCAN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


@query("find_emails_documents", rf"WITH e AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{SCAN}'))) AS e FROM documents WHERE contains(text, '@')) SELECT doc_id, e AS email, length(e) <= 254 AND {_junk('e')} AS valid, count(*) AS n FROM e GROUP BY doc_id, e")
def _(spark, d):
    found = F.explode(F.regexp_extract_all("text", F.lit(SCAN), F.lit(0))).alias("raw")
    rows = read(spark, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", found)
    rows = rows.select("doc_id", F.lower("raw").alias("email"), text.validate_email(F.col("raw")).isNotNull().alias("valid"))
    return rows.groupBy("doc_id", "email", "valid").agg(F.count("*").alias("n"))


@query("find_emails_in_texts")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.find_emails(F.col("text")).alias("emails"))


NOTE = "CASE seq % 4 WHEN 0 THEN 'Write to Info' || seq || '&#64;acme.ae, sales@acme.ae or info' || seq || '@acme.ae; logo@2x.png' WHEN 1 THEN '<p>info' || seq || ' [at] acme [dot] ae and x@sentry.io</p>' WHEN 2 THEN '<a data-cfemail=\"5a33343c351a3b39373f743b3f\">x</a> b' || seq || '@acme.ae' END"


@on_leads("find_emails_in_notes", "SELECT seq, CASE seq % 4 WHEN 0 THEN 'info' || seq || '@acme.ae,sales@acme.ae' WHEN 1 THEN 'info' || seq || '@acme.ae' WHEN 2 THEN 'info@acme.ae,b' || seq || '@acme.ae' ELSE '' END AS emails FROM leads")
def _(df):
    return df.select("seq", F.array_join(text.find_emails(F.expr(NOTE)), ",").alias("emails"))


@on_leads("find_email_in_html", "SELECT seq, CASE seq % 3 WHEN 0 THEN 'sales' || seq || '@acme.ae' WHEN 1 THEN CASE seq % 4 WHEN 2 THEN 'info@acme.ae' WHEN 3 THEN NULL ELSE 'info' || seq || '@acme.ae' END END AS email FROM leads")
def _(df):
    page = F.expr(f"CASE seq % 3 WHEN 0 THEN '<a href=\"mailto:x@sentry.io\">a</a> info@acme.ae <a href=\"mailto:Sales' || seq || '@Acme.ae?subject=a\">' WHEN 1 THEN {NOTE} END")
    return df.select("seq", text.find_email_in_html(page).alias("email"))


@query("find_email_pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", text.find_email_in_html(F.col("html")).alias("email"))


@on_leads("decode_cf_email", rf"SELECT seq, CASE WHEN regexp_matches(e, '^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}$') AND {_junk('e')} THEN e END AS email FROM (SELECT seq, lower(email) AS e FROM leads)")
def _(df):
    hidden = F.expr("concat('5a', array_join(transform(sequence(1, length(email)), i -> lpad(lower(hex(ascii(substring(email, i, 1)) ^ 90)), 2, '0')), ''))")
    return df.select("seq", text.decode_cf_email(hidden).alias("email"))


@query("clean_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS digest FROM documents WHERE trim(text, E' \n\t') <> ''")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("digest")).where("digest is not null")


PAGE = "'<a href=\"https://facebook.com/sharer?u=1\"></a><a href=\"https://facebook.com/Shop' || seq || '\"></a> <a href=\"twitter.com/Shop' || seq || '\"> x <a href=\"https://www.linkedin.com/company/shop-' || seq || '\"> <a href=\"//tiktok.com/shop' || seq || '\"> <a href=\"https://youtube.com/channel/UC' || seq || '\">'"


@on_leads("social_links", "SELECT seq, 'https://www.facebook.com/Shop' || seq AS facebook, CAST(NULL AS VARCHAR) AS instagram, CASE WHEN length('Shop' || seq) <= 15 THEN 'https://www.x.com/shop' || seq END AS twitter, 'https://www.linkedin.com/company/shop-' || seq AS linkedin, 'https://www.youtube.com/channel/UC' || seq AS youtube, 'https://www.tiktok.com/@shop' || seq AS tiktok FROM leads")
def _(df):
    return df.select("seq", text.social_links(F.expr(PAGE)).alias("s")).select("seq", "s.*")


@on_leads("social_url_normalise", "SELECT seq, 'https://www.x.com/acme' || seq AS twitter, CASE WHEN instagram IS NOT NULL THEN 'https://www.instagram.com/acme' || seq END AS instagram FROM leads")
def _(df):
    page = F.concat(F.lit("https://twitter.com/Acme"), F.col("seq"), F.lit('" '), F.coalesce("instagram", F.lit("")), F.lit('"'))
    return df.select("seq", text.social_links(page).alias("s")).select("seq", F.col("s.twitter").alias("twitter"), F.col("s.instagram").alias("instagram"))


@query("bot_challenge_pages", "SELECT page_id, length(html) < 200 OR (length(html) < 20000 AND regexp_matches(lower(html), 'just a moment\\.\\.\\.|enable javascript|cloudflare|attention required!|ddos-guard|verify you are human')) AS challenge FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", text.is_bot_challenge(F.col("html")).alias("challenge"))


HREF_SQL = """unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1))"""


CONTACT = "'<a href=\"/contact-' || seq || '?x=1\">c</a><a class=b href=\"https://www.site' || seq || '.example.org/About/' || city || '#t\">a</a><a href=\"team' || seq % 5 || '.html\">t</a><a href=\"/contact-' || seq || '\">again</a><a href=\"https://elsewhere.example.net/contact\">x</a><a href=\"/shop\">s</a><a href=\"mailto:a@b.org\">m</a><a href=\"//site' || seq || '.example.org/impressum;v=2\">i</a>'"


@on_leads("contact_links", "SELECT seq, unnest(['/contact-' || seq, '/About/' || city, '/de/team' || seq % 5 || '.html', '/impressum']) AS path, unnest([1, 2, 3, 4]) AS place FROM leads")
def _(df):
    base = F.concat(F.lit("https://site"), "seq", F.lit(".example.org/de/index.html?q=1"))
    found = F.posexplode(urls.contact_paths(F.expr(CONTACT), base)).alias("place", "path")
    return df.select("seq", found).select("seq", "path", (F.col("place") + 1).cast("int").alias("place"))


@query("page_links", f"SELECT DISTINCT page_id, trim(h) AS link FROM (SELECT page_id, {HREF_SQL} AS h FROM pages) WHERE trim(h) <> ''")
def _(spark, d):
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(urls.HREF), F.lit(1)), F.trim))
    return read(spark, d, "pages").select("page_id", F.explode(links).alias("link")).where("link <> ''")


@query("page_link_hosts", "SELECT host, count(*) AS n FROM (SELECT ltrim(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'w.') AS host FROM pages) GROUP BY host")
def _(spark, d):
    return read(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@on_leads("coords_from_url", "SELECT seq, CASE WHEN ok THEN CAST(lat AS DOUBLE) END AS lat, CASE WHEN ok THEN CAST(lng AS DOUBLE) END AS lng FROM (SELECT *, lat <= 90 AND lng >= -180 AS ok FROM (SELECT seq, CAST(latitude AS DECIMAL(10, 4)) + 0.0101 AS lat, CAST(longitude AS DECIMAL(10, 4)) - 0.0101 AS lng FROM leads))")
def _(df):
    lat, lng = F.expr("cast(cast(latitude as decimal(10,4)) + 0.0101 as string)"), F.expr("cast(cast(longitude as decimal(10,4)) - 0.0101 as string)")
    at = F.concat(F.lit("https://maps.example.com/place/x/@"), lat, F.lit(","), lng, F.lit(",17z"))
    data = F.concat(F.lit("https://maps.example.com/place/x/data=!3d"), lat, F.lit("!4d"), lng)
    c = urls.coords_of_url(F.when(F.col("seq") % 2 == 0, at).otherwise(data))
    return df.select("seq", c["lat"].alias("lat"), c["lng"].alias("lng"))


@on_leads("place_id_from_url", "SELECT seq, CASE seq % 3 WHEN 0 THEN '0x' || lower(to_hex(seq)) || ':0xabc' WHEN 1 THEN 'ChIJ' || seq END AS place_id, CASE seq % 3 WHEN 1 THEN 'ChIJ' || seq WHEN 2 THEN 'ChIJ-' || seq END AS data_id FROM leads")
def _(df):
    u = F.expr("CASE seq % 3 WHEN 0 THEN concat('https://m/place/data=!1s0x', lower(hex(seq)), ':0xabc!8m2') WHEN 1 THEN concat('https://m/?place_id=ChIJ', seq) ELSE concat('https://m/data=!1sChIJ%2D', seq, '!x') END")
    return df.select("seq", urls.place_id_of_url(u).alias("place_id"), urls.place_id_of_data(u).alias("data_id"))


@on_leads("website_unwrap", "SELECT seq, CASE WHEN seq % 2 = 0 THEN website WHEN seq % 3 = 0 THEN NULL ELSE 'https://' || seq || '.example.net' END AS url FROM leads")
def _(df):
    href = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("https://maps.example.com/url?q="), F.url_encode("website"), F.lit("&sa=1"))).when(F.col("seq") % 3 == 0, F.col("instagram")).otherwise(F.concat(F.col("seq"), F.lit(".example.net")))
    return df.select("seq", urls.unwrap_website(href).alias("url"))


@on_leads("search_urls", "SELECT seq, 'https://maps.example.com/search/' || replace(source_query, ' ', '+') || '/' AS url FROM leads")
def _(df):
    return df.select("seq", F.concat(F.lit("https://maps.example.com/search/"), urls.query_plus(F.col("source_query")), F.lit("/")).alias("url"))


# --- field parsers --------------------------------------------------------------------------------------------------


@on_leads("address_by_dashes", "SELECT seq, business_name AS street, city, country FROM leads")
def _(df):
    a = fields.address_components(F.concat_ws(" - ", F.lit("Floor 3"), "business_name", "city", "country"))
    return df.select("seq", a["street"].alias("street"), a["city"].alias("city"), a["country"].alias("country"))


@on_leads("address_by_commas", "SELECT seq, (seq % 900) || ' Main St' AS street, city, CAST(10001 + seq % 80000 AS VARCHAR) AS postal_code, country FROM leads")
def _(df):
    a = fields.address_components(F.expr("concat(seq % 900, ' Main St, ', city, ', NY ', 10001 + seq % 80000, ', ', country)"))
    return df.select("seq", a["street"].alias("street"), a["city"].alias("city"), a["postal_code"].alias("postal_code"), a["country"].alias("country"))


STATUS = "CASE seq % 5 WHEN 0 THEN 'Closed · Opens 12 PM' WHEN 1 THEN ' Closes soon' WHEN 2 THEN 'Open 24 hours' WHEN 3 THEN 'Temporarily closed' END"


@on_leads("hours_open_flag", "SELECT seq, CASE seq % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true END AS is_open FROM leads")
def _(df):
    return df.select("seq", fields.open_flag(F.expr(STATUS)).alias("is_open"))


@on_leads("hours_by_day", "SELECT seq, (1 + seq % 11) || ' AM-9 PM' AS monday, CASE WHEN seq % 2 = 0 THEN 'Closed' ELSE '10 AM to 5 PM' END AS sunday, CAST(2 AS INT) AS days FROM leads")
def _(df):
    label = F.expr("concat('Monday, ', 1 + seq % 11, ' AM–9 PM, Sunday, ', CASE WHEN seq % 2 = 0 THEN 'Closed' ELSE '10 AM to 5 PM' END)")
    h = fields.valid_hours(fields.hours_by_day(label))
    return df.select("seq", h["monday"].alias("monday"), h["sunday"].alias("sunday"), fields.count_days(h).alias("days"))


@on_leads("price_level", "SELECT seq, CASE seq % 5 WHEN 0 THEN '$$' WHEN 1 THEN '$' WHEN 2 THEN '$$' WHEN 3 THEN '$$$' END AS price FROM leads")
def _(df):
    raw = F.expr("CASE seq % 5 WHEN 0 THEN 'Price: $$' WHEN 1 THEN 'Inexpensive' WHEN 2 THEN 'Moderately expensive' WHEN 3 THEN 'Very expensive' ELSE city END")
    return df.select("seq", fields.price_level(raw).alias("price"))


@on_leads("attribute_groups", "SELECT seq, 'Wheelchair accessible entrance' AS accessibility, CASE WHEN seq % 2 = 0 THEN 'Dine-in' ELSE 'Delivery' END AS service_options, 'Wheelchair accessible entrance, ' || CASE WHEN seq % 2 = 0 THEN 'Dine-in' ELSE 'Delivery' END AS cleaned FROM leads")
def _(df):
    tags = F.array(F.lit(" Wheelchair accessible entrance"), F.when(F.col("seq") % 2 == 0, "Dine-in").otherwise("Delivery"), F.lit("Save"), F.lit("Wheelchair accessible entrance"))
    clean = fields.clean_attributes(tags)
    g = fields.attribute_groups(clean)
    return df.select("seq", F.array_join(g["accessibility"], ", ").alias("accessibility"), F.array_join(g["service_options"], ", ").alias("service_options"), fields.all_attributes(clean).alias("cleaned"))


@on_leads("format_reviews", "SELECT seq, business_name || ' (' || (seq % 5) || '★): ' || coalesce(left(description, 150), '') || ' [' || city || '] | Anonymous (' || (seq % 4) || '★):  []' AS reviews FROM leads")
def _(df):
    one = F.struct(F.col("business_name").alias("author"), (F.col("seq") % 5).alias("rating"), F.col("description").alias("text"), F.col("city").alias("date"))
    two = F.struct(F.lit(None).cast("string").alias("author"), (F.col("seq") % 4).alias("rating"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("date"))
    return df.select("seq", fields.reviews_text(F.array(one, two)).alias("reviews"))


@on_leads("upsize_image", "SELECT seq, 'https://img/' || seq || '=w1200-h900-p-k-no' AS url, seq % 200 + 1 <= 100 AS tiny FROM leads")
def _(df):
    url = F.expr("concat('https://img/', seq, '=w', seq % 200 + 1, '-h300-p-k-no')")
    return df.select("seq", urls.upsize_image(url).alias("url"), urls.is_tiny_image(url).alias("tiny"))


@query("valid_descriptions", r"SELECT doc_id, length(trim(text, E' \n\t\r')) >= 30 AND NOT regexp_matches(trim(text, E' \n\t\r'), '^[✔✓✅☑]') AND NOT regexp_matches(text, '(?i)(updated|confirmed) by this business') AND NOT regexp_matches(trim(text, E' \n\t\r'), '^\d+\.\d+\s+\w') AND NOT regexp_matches(text, '(?i)\b(wheelchair|accessible|accessibility|hearing loop|listening device|parking lot|parking garage|restroom|assisted listening)\b') AND NOT regexp_matches(trim(text, E' \n\t\r'), '(?i)^[\w\s&-]+(restaurant|café|cafe|bar|lounge|bistro|brasserie)[\s·•]*$') AS ok FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", fields.is_valid_description(F.col("text")).alias("ok"))


@query("garbage_attributes", r"SELECT p_partkey, length(trim(p_name)) = 0 OR length(trim(p_name)) > 60 OR regexp_matches(trim(p_name), '(?i)^[\w.-]+\.[a-z]{2,6}(/\S*)?$') OR regexp_matches(trim(p_name), '(?i)^[A-Z0-9]{4,6}\+[A-Z0-9]{2,4}') OR regexp_matches(trim(p_name), '(?i)^floor\s+\d') AS garbage FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", fields.is_garbage_attribute(F.col("p_name")).alias("garbage"))


# --- geo grid -------------------------------------------------------------------------------------------------------

#: A box for each supplier, so that the grid grows with the tables.
BOX = "s_suppkey AS id, s_suppkey % 60 + 1.31 AS north, s_suppkey % 60 + 1.0 AS south, s_suppkey % 170 + 0.27 AS east, CAST(s_suppkey % 170 AS DOUBLE) AS west"
BOX_SQL = f"SELECT CAST(id AS INT) AS id, CAST(north AS DOUBLE) AS north, CAST(south AS DOUBLE) AS south, CAST(east AS DOUBLE) AS east, west FROM (SELECT {BOX} FROM supplier)"
CELLS_SQL = f"""box AS ({BOX_SQL}), step AS (SELECT *, 2.0 / 111.0 AS ls, 2.0 / (111.0 * cos(radians((north + south) / 2))) AS gs FROM box),
    cell AS (SELECT id, 'r' || r || '_c' || c AS cell_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, south + r * ls + ls / 2 AS y, west + c * gs + gs / 2 AS x, north, east FROM step, generate_series(0, 40) t(r), generate_series(0, 40) u(c)),
    cells AS (SELECT id, cell_id, row, col, round(y, 6) AS lat, round(x, 6) AS lng FROM cell WHERE y <= north AND x <= east)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "supplier").selectExpr(*[e.strip() for e in BOX.split(", ")])
    return b.select(F.col("id").cast("int").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("north", "south", "east", "west")])


def marked_cells(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    cells = geo.grid_cells(boxes(spark, d), 2.0, parts)
    n = F.col("row") * 7 + F.col("col") * 3 + F.col("id")
    return cells.withColumns({"is_scraped": n % 3 != 0, "is_empty": n % 5 == 0, "result_count": (n * 11 % 160).cast("int")})


MARKED_SQL = f"{CELLS_SQL}, marked AS (SELECT *, n % 3 <> 0 AS is_scraped, n % 5 = 0 AS is_empty, n * 11 % 160 AS result_count FROM (SELECT *, row * 7 + col * 3 + id AS n FROM cells))"


@query("box_metrics", f"SELECT id, round(center_lat, 6) AS center_lat, round(center_lng, 6) AS center_lng, round((north - south) * 111.0, 6) AS height_km, round((east - west) * 111.0 * cos(radians(center_lat)), 6) AS width_km FROM (SELECT *, (north + south) / 2 AS center_lat, (east + west) / 2 AS center_lng FROM ({BOX_SQL}))")
def _(spark, d):
    m = geo.box_metrics(boxes(spark, d))
    return m.select("id", *[F.round(c, 6).alias(c) for c in ("center_lat", "center_lng", "height_km", "width_km")])


@query("grid_cells", f"WITH {CELLS_SQL} SELECT id, cell_id, row, col, lat, lng, CAST(14 AS INT) AS zoom FROM cells")
def _(spark, d):
    return geo.grid_cells(boxes(spark, d), 2.0).select("id", "cell_id", "row", "col", "lat", "lng", "zoom")


@query("grid_subdivide", f"WITH {CELLS_SQL} SELECT id, cell_id || '_s' || a || b AS cell_id, round(lat - 1.0 / 111.0 + (a + 0.5) * (2.0 / 2 / 111.0), 6) AS lat, round(lng - 1.0 / (111.0 * cos(radians(lat))) + (b + 0.5) * (2.0 / 2 / (111.0 * cos(radians(lat)))), 6) AS lng, CAST(15 AS INT) AS zoom FROM cells, range(2) t(a), range(2) u(b)")
def _(spark, d):
    return geo.subdivide(geo.grid_cells(boxes(spark, d), 2.0)).select("id", "cell_id", "lat", "lng", "zoom")


@query("cell_bounds", f"WITH {CELLS_SQL} SELECT id, cell_id, round(lat + 1.0 / 111.0, 6) + 0.0 AS north, round(lat - 1.0 / 111.0, 6) + 0.0 AS south, round(lng + 1.0 / (111.0 * cos(radians(lat))), 6) + 0.0 AS east, round(lng - 1.0 / (111.0 * cos(radians(lat))), 6) + 0.0 AS west FROM cells")
def _(spark, d):
    b = geo.cell_bounds(geo.grid_cells(boxes(spark, d), 2.0))
    return b.select("id", "cell_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("north", "south", "east", "west")])


@query("adaptive_cells", f"WITH {MARKED_SQL} SELECT id, cell_id || s AS cell_id FROM (SELECT id, cell_id, '' AS s FROM marked WHERE result_count < 120 UNION ALL SELECT id, cell_id, '_s' || a || b FROM marked, range(2) t(a), range(2) u(b) WHERE result_count >= 120)")
def _(spark, d):
    return geo.refine(marked_cells(spark, d), 120).select("id", "cell_id")


@query("grid_stats", f"WITH {MARKED_SQL} SELECT id, count(*) AS total, count_if(is_scraped) AS scraped, count_if(NOT is_scraped) AS unscraped, count_if(is_empty) AS empty, count(*) - count_if(is_empty) AS populated, CAST(sum(result_count) AS BIGINT) AS results, round(count_if(is_scraped) / count(*) * 100, 1) AS completion_pct FROM marked GROUP BY id")
def _(spark, d):
    return geo.grid_stats(marked_cells(spark, d), "id").withColumns({c: F.col(c).cast("long") for c in ("total", "scraped", "unscraped", "empty", "populated")})


@query("grid_selectors", f"WITH {MARKED_SQL} SELECT id, cell_id, NOT is_scraped AND NOT is_empty AS unscraped, is_scraped AS scraped, is_empty AS empty FROM marked")
def _(spark, d):
    return geo.cell_selectors(marked_cells(spark, d)).select("id", "cell_id", "unscraped", "scraped", "empty")


@query("scrape_estimate", f"WITH {MARKED_SQL}, n AS (SELECT id, count(*) AS total_cells, count_if(NOT is_empty) AS p FROM marked GROUP BY id) SELECT id, total_cells, p AS populated_cells, total_cells - p AS empty_cells, CAST(72 AS BIGINT) AS avg_leads_per_cell, p * 72 AS estimated_leads, p * 2615 AS estimated_seconds, round_even(p * 2615 / 60, 1) AS estimated_minutes, round_even(p * 2615 / 3600, 2) AS estimated_hours FROM n")
def _(spark, d):
    return geo.scrape_estimate(marked_cells(spark, d), 3.0, 36.0, 23.0, "id")


@query("zoom_ladder", "SELECT p_partkey, CASE WHEN k >= 16 THEN 11 WHEN k >= 8 THEN 12 WHEN k >= 4 THEN 13 WHEN k >= 2 THEN 14 WHEN k >= 1 THEN 15 WHEN k >= 0.5 THEN 16 ELSE 17 END AS zoom, CAST(least(120, round_even(k * k * 8, 0)) AS BIGINT) AS leads, CASE WHEN a < 100 THEN 0.5 WHEN a < 500 THEN 1.0 WHEN a < 2000 THEN 2.0 WHEN a < 10000 THEN 3.0 WHEN a < 50000 THEN 5.0 ELSE 10.0 END AS cell_km FROM (SELECT p_partkey, p_partkey % 200 / 10.0 AS k, CAST(p_partkey * 37 % 60000 AS DOUBLE) AS a FROM part)")
def _(spark, d):
    k, a = (F.col("p_partkey") % 200) / 10.0, (F.col("p_partkey") * 37 % 60000).cast("double")
    return read(spark, d, "part").select("p_partkey", geo.zoom(k).alias("zoom"), geo.leads_per_cell(k).alias("leads"), geo.optimal_cell_size(a).alias("cell_km"))


BUILDINGS_SQL = "CASE WHEN n >= 100 THEN 0.95 WHEN n >= 50 THEN 0.90 WHEN n >= 20 THEN 0.85 WHEN n >= 5 THEN 0.75 ELSE 0.65 END"


@query("classify_buildings", f"SELECT p_partkey, n >= 5 AS is_populated, CAST({BUILDINGS_SQL} AS DOUBLE) AS confidence FROM (SELECT p_partkey, p_partkey * 7 % 130 AS n FROM part)")
def _(spark, d):
    r = geo.by_buildings(F.col("p_partkey") * 7 % 130)
    return read(spark, d, "part").select("p_partkey", r["is_populated"].alias("is_populated"), r["confidence"].alias("confidence"))


@query("classify_landuse", "SELECT p_partkey, k <> 1 AS is_populated, CAST(CASE k WHEN 0 THEN 0.80 WHEN 1 THEN 0.75 ELSE 0.50 END AS DOUBLE) AS confidence FROM (SELECT p_partkey, p_partkey % 3 AS k FROM part)")
def _(spark, d):
    tags = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Residential"), F.lit("water"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("Forest"))).otherwise(F.array(F.lit("unknown")))
    r = geo.by_landuse(tags)
    return read(spark, d, "part").select("p_partkey", r["is_populated"].alias("is_populated"), r["confidence"].alias("confidence"))


@query("classify_dispatch", f"""SELECT p_partkey, n >= 5 OR k <> 1 AS combined, round((b + l) / 2, 6) AS combined_confidence, CASE WHEN b >= 0.7 THEN n >= 5 WHEN l >= 0.7 THEN k <> 1 ELSE n >= 5 END AS auto, CASE WHEN n >= 1 THEN 0.95 ELSE 0.70 END AS quick_confidence
    FROM (SELECT *, CAST({BUILDINGS_SQL} AS DOUBLE) AS b, CAST(CASE k WHEN 1 THEN 0.75 ELSE 0.50 END AS DOUBLE) AS l FROM (SELECT p_partkey, p_partkey * 7 % 130 AS n, p_partkey % 3 AS k FROM part))""")
def _(spark, d):
    n = F.col("p_partkey") * 7 % 130
    b, land, quick = geo.by_buildings(n), geo.by_landuse(F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit("sand"))).otherwise(F.array(F.lit("?")))), geo.by_results(n, F.lit(False))
    combined, auto = geo.classify("combined", b, land), geo.classify("auto", b, land)
    return read(spark, d, "part").select("p_partkey", combined["is_populated"].alias("combined"), F.round(combined["confidence"], 6).alias("combined_confidence"), auto["is_populated"].alias("auto"), geo.classify("quick", b, land, quick)["confidence"].alias("quick_confidence"))


def place(names: list[str]) -> tuple[str, str]:
    """A place name for each lead as an expression: the dimension's names and two unknown ones, in turn (Spark, DuckDB)."""
    array, n = ", ".join(f"'{n}'" for n in [*names, "narnia", "ca"]), len(names) + 2
    return f"concat(' ', initcap(element_at(array({array}), CAST(seq % {n} AS INT) + 1)))", f"[{array}][CAST(seq % {n} AS INT) + 1]"


CITY, CITY_SQL = place([c[0] for c in dims.CITIES])
COUNTRY, COUNTRY_SQL = place([c[0] for c in dims.COUNTRIES])


@on_leads("city_bounds_lookup", f"SELECT seq, north, south, east, west FROM (SELECT seq, {CITY_SQL} AS c FROM leads) LEFT JOIN (VALUES {', '.join('(' + repr(c[0]) + ', ' + ', '.join(f'CAST({v} AS DOUBLE)' for v in c[1:]) + ')' for c in dims.CITIES)}) t(name, north, south, east, west) ON c = name")
def _(df):
    found = dims.with_city_box(df.select("seq", F.expr(CITY).alias("place")), "place")
    return found.select("seq", *[F.col(c) for c in ("north", "south", "east", "west")])


@on_leads("country_code", f"SELECT seq, CASE WHEN length(c) = 2 THEN c ELSE code END AS code FROM (SELECT seq, {COUNTRY_SQL} AS c FROM leads) LEFT JOIN (VALUES {', '.join(str(c) for c in dims.COUNTRIES)}) t(name, code) ON c = name")
def _(df):
    return dims.with_country_code(df.select("seq", F.expr(COUNTRY).alias("place")), "place").select("seq", "code")


@query("best_hit", "SELECT s_nationkey, s_acctbal, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) WHERE rn = 1")
def _(spark, d):
    return stats.best(read(spark, d, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey")


# --- flat exports ---------------------------------------------------------------------------------------------------


def nested(df: DataFrame) -> DataFrame:
    """Leads as nested business records."""
    null = F.lit(None).cast("string")
    s = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    c = F.col
    return df.select(
        "seq", "business_name", "place_id", c("maps_url").alias("google_maps_url"),
        s(full_address=F.concat_ws(", ", "city", "country"), street=null, city=c("city"), state=null, postal_code=null, country=c("country")).alias("address"),
        s(phone=c("phone"), website=c("website"), email=c("email")).alias("contact"),
        s(facebook=c("facebook"), instagram=c("instagram"), twitter=null, linkedin=null, youtube=null, tiktok=null).alias("social_media"),
        s(category=c("category"), all_categories=c("all_categories"), description=c("description"), price_level=F.when(c("seq") % 2 == 0, "$$"), years_in_business=null).alias("business_info"),
        s(latitude=c("latitude"), longitude=c("longitude")).alias("coordinates"),
        s(current_status=F.when(c("seq") % 3 == 0, "Open")).alias("hours"),
        s(amenities=F.array(F.lit("Wi-Fi"), F.lit(" Toilets")), payments_accepted=F.array(F.lit("Wi-Fi")), service_options=F.when(c("seq") % 2 == 0, F.array(F.lit("Delivery"))), highlights=F.lit(None).cast("array<string>")).alias("attributes"),
        s(main_image_url=F.concat(F.lit("https://img/"), "seq"), all_image_urls=F.array().cast("array<string>")).alias("images"),
        F.array(s(author=c("business_name"), rating=(c("seq") % 5).cast("int"), text=F.lit("Good"), date=c("city"))).alias("reviews_sample"),
        s(average_rating=c("average_rating"), total_reviews=c("total_reviews")).alias("ratings"),
        s(query=c("source_query"), scraped_at=null).alias("metadata"),
    )


@on_leads("flatten_leads", """SELECT business_name AS "Business Name", place_id AS "Place ID", city || ', ' || country AS "Full Address", phone AS "Phone", replace(categories, '|', ', ') AS "All Categories", average_rating AS "Rating", CAST(NULL AS VARCHAR) AS "State" FROM leads""")
def _(df):
    from ..operators.flatten import flatten_business

    return flatten_business(nested(df)).select("Business Name", "Place ID", "Full Address", "Phone", "All Categories", "Rating", "State")


@on_leads("flatten_generic", """SELECT place_id, contact_phone, "list", average_rating AS ratings_average_rating FROM (SELECT place_id, phone AS contact_phone, '[''' || replace(categories, '|', ''', ''') || ''']' AS "list", average_rating FROM leads)""".replace('"list"', "business_info_all_categories"))
def _(df):
    from ..operators.flatten import flatten_generic

    return flatten_generic(nested(df)).select("place_id", "contact_phone", "business_info_all_categories", "ratings_average_rating")


@on_leads("prune_empty", "SELECT seq, phone, facebook, status FROM leads")
def _(df):
    from ..operators.flatten import prune_empty

    return prune_empty(df.select("seq", "phone", "facebook", "twitter", "tiktok", "status"))


@on_leads("column_widths", 'SELECT \'city\' AS "column", CAST(least(greatest(max(length(city)), 4) + 2, 60) AS INT) AS width FROM leads UNION ALL SELECT \'maps_url\', CAST(least(greatest(max(length(maps_url)), 8) + 2, 60) AS INT) FROM leads UNION ALL SELECT \'total_reviews\', CAST(least(greatest(max(length(CAST(total_reviews AS VARCHAR))), 13) + 2, 60) AS INT) FROM leads')
def _(df):
    return stats.column_widths(df.select("city", "maps_url", "total_reviews"))


# --- statistics -----------------------------------------------------------------------------------------------------


@query("metric_stats", "SELECT event_type, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stddev, round(min(value), 4) AS min, round(max(value), 4) AS max FROM events GROUP BY event_type")
def _(spark, d):
    return stats.metric_stats(read(spark, d, "events"), ["event_type"], "value")


@query("config_delta", "SELECT printf('%+.2f', avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type = 'view')) AS delta FROM events")
def _(spark, d):
    return stats.config_delta(read(spark, d, "events"), "event_type", "value", "purchase", "view")


@query("run_counters", "SELECT count_if(event_type = 'purchase') AS scraped, count_if(event_type = 'error') AS failed, count(DISTINCT user_id) AS unique_ids, count(*) - count(DISTINCT user_id) AS duplicates FROM events")
def _(spark, d):
    users = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "error").alias("e"))
    return users.agg(F.sum("p").alias("scraped"), F.sum("e").alias("failed"), F.count("*").alias("unique_ids"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query("trigger_rate", "SELECT user_id, rate, should, CASE WHEN should = 1 THEN rate >= 0.5 ELSE rate < 0.5 END AS passed FROM (SELECT user_id, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS rate, CAST(max(user_id % 2) AS INT) AS should FROM events GROUP BY user_id)")
def _(spark, d):
    return stats.trigger_rate(read(spark, d, "events"), "user_id", F.coalesce(F.col("value") > 50, F.lit(False)), F.col("user_id") % 2 == 1)


@query("confusion_metrics", "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0 END AS accuracy FROM (SELECT event_type, count_if(p AND a) AS tp, count_if(p AND NOT a) AS fp, count_if(NOT p AND a) AS fn, count_if(NOT p AND NOT a) AS tn FROM (SELECT event_type, coalesce(value > 60, false) AS p, user_id % 3 = 0 AS a FROM events) GROUP BY event_type)")
def _(spark, d):
    return stats.confusion(read(spark, d, "events"), ["event_type"], F.col("value") > 60, F.col("user_id") % 3 == 0)


@query("score_classes", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN s >= 0.8 THEN 'good' WHEN s >= 0.5 THEN 'ok' ELSE 'bad' END AS class FROM (SELECT avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS s FROM lineitem GROUP BY l_orderkey)) GROUP BY class")
def _(spark, d):
    rates = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg((F.col("l_returnflag") == "N").cast("int")).alias("s"))
    return rates.groupBy(stats.score_class(F.col("s")).alias("class")).agg(F.count("*").alias("n"))


@query("best_iteration", "SELECT o_custkey, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(spark, d):
    return stats.best(read(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("stratified_split", "SELECT event_type, greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS test_rows, count(*) AS all_rows FROM events GROUP BY event_type")
def _(spark, d):
    split = stats.stratified_split(read(spark, d, "events"), "event_type", "event_id", 0.2)
    return split.groupBy("event_type").agg(F.count_if("test").alias("test_rows"), F.count("*").alias("all_rows"))


@query("no_new_streak", """WITH e AS (SELECT user_id, event_id, CASE WHEN value > 40 THEN 1 ELSE 0 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e),
    s AS (SELECT *, sum(1 - new) OVER (PARTITION BY user_id, g ORDER BY event_id) AS k FROM i) SELECT user_id, min(event_id) FILTER (k >= 5) AS stop_at FROM s GROUP BY user_id""")
def _(spark, d):
    marked = read(spark, d, "events").withColumn("new", F.coalesce((F.col("value") > 40).cast("int"), F.lit(0)))
    return stats.streak_stop(marked, "user_id", "event_id", "new", 5)


@query("every_n_markers", "SELECT event_id, (rn - 1) % 40 = 0 AS take_break, (rn - 1) % 100 = 0 AS restart, (rn - 1) % 10 = 0 AS checkpoint FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)")
def _(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return read(spark, d, "events").select("event_id", *[(n % k == 0).alias(c) for c, k in (("take_break", 40), ("restart", 100), ("checkpoint", 10))])


from . import records  # noqa: E402, F401 - registers its queries here
from . import history  # noqa: E402, F401
from . import stored  # noqa: E402, F401
