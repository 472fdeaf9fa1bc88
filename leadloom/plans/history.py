"""Registered queries of change detection, cross-query dedup, duplicate reports and lead scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..operators import changes, linking, score
from .queries import ORACLE_SQL, on_leads
from .scratch import scratch

# --- change detection -------------------------------------------------------------------------------------------------

FIELDS = ["business_name", "city", "phone", "website", "average_rating", "total_reviews"]
#: Three collections of the leads: what each of them holds, and how values differ in it.
SNAPSHOTS = [
    {"where": "seq % 11 <> 0"},
    {"where": "seq % 13 <> 0", "phone": "CASE WHEN seq % 7 = 3 THEN '+971 9 ' || CAST(seq AS STRING) ELSE phone END", "average_rating": "CASE WHEN seq % 5 = 1 THEN average_rating / 2 ELSE average_rating END"},
    {"where": "seq % 17 <> 3", "phone": "CASE WHEN seq % 7 = 3 THEN '+971 9 ' || CAST(seq AS STRING) ELSE phone END", "website": "CASE WHEN seq % 19 = 4 THEN NULL ELSE website END", "total_reviews": "CASE WHEN seq % 23 = 1 THEN coalesce(total_reviews, 0) + 1 ELSE total_reviews END"},
]


def snapshot(df: DataFrame, n: int) -> DataFrame:
    how = SNAPSHOTS[n]
    return df.where(how["where"]).selectExpr("seq", "place_id", *[f"{how.get(f, f)} AS {f}" for f in FIELDS])


def _snapshot_sql(n: int) -> str:
    how = SNAPSHOTS[n]
    fields = ", ".join(f"{how.get(f, f)} AS {f}".replace("AS STRING", "AS VARCHAR") for f in FIELDS)
    return f"s{n} AS (SELECT * EXCLUDE (rn) FROM (SELECT seq, place_id, {fields}, row_number() OVER (PARTITION BY place_id ORDER BY seq DESC) AS rn FROM leads WHERE place_id <> '' AND {how['where']}) WHERE rn = 1)"


PAIRS = " UNION ALL ".join(f"SELECT b.place_id, '{f}' AS field, CAST(a.{f} AS VARCHAR) AS before, CAST(b.{f} AS VARCHAR) AS after FROM s0 a JOIN s1 b USING (place_id) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in FIELDS)
CHANGES_SQL = f""", {_snapshot_sql(0)}, {_snapshot_sql(1)}, changes AS (SELECT place_id, 'changed' AS change, field, before, after FROM ({PAIRS})
    UNION ALL SELECT place_id, 'added', NULL, NULL, NULL FROM s1 WHERE place_id NOT IN (SELECT place_id FROM s0)
    UNION ALL SELECT place_id, 'removed', NULL, NULL, NULL FROM s0 WHERE place_id NOT IN (SELECT place_id FROM s1))"""


def _changes(df: DataFrame) -> DataFrame:
    old, new = (changes.version(snapshot(df, n), "place_id", FIELDS, order="seq") for n in (0, 1))
    return changes.field_changes(old, new, "place_id", FIELDS)


@on_leads("change_detection", f"{CHANGES_SQL} SELECT * FROM changes")
def _(df):
    return _changes(df)


@on_leads("change_summary", f"{CHANGES_SQL} SELECT change, field, count(*) AS records FROM changes GROUP BY change, field")
def _(df):
    return changes.change_summary(_changes(df))


SAME = " AND ".join(f"{f} IS NOT DISTINCT FROM lag({f}) OVER w" for f in FIELDS)
COLUMNS = ", ".join(FIELDS)


@on_leads("change_history", f""", {_snapshot_sql(0)}, {_snapshot_sql(1)}, {_snapshot_sql(2)}, v AS ({" UNION ALL ".join(f"SELECT {n} AS v, * FROM s{n}" for n in range(3))}),
    m AS (SELECT *, CASE WHEN lag(v) OVER w = v - 1 AND {SAME} THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY place_id ORDER BY v)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY place_id ORDER BY v) AS g FROM m)
    SELECT place_id, {", ".join(f"any_value({f}) AS {f}" for f in FIELDS)}, CAST(min(v) AS INT) AS valid_from, CASE WHEN max(v) < 2 THEN CAST(max(v) + 1 AS INT) END AS valid_to FROM g GROUP BY place_id, g""")  # fmt: skip
def _(df):
    """Days since the first collection for which each version of a record held."""
    day = lambda n: F.timestamp_seconds(F.lit(86400 * n))
    df.sparkSession.sparkContext.setCheckpointDir(scratch(df.sparkSession))
    open_, closed = None, []
    for n in range(len(SNAPSHOTS)):
        ended, open_ = changes.advance(open_, changes.version(snapshot(df, n), "place_id", FIELDS, order="seq"), "place_id", FIELDS, day(n))
        open_ = open_.checkpoint()
        closed.append(ended)
    whole = open_
    for part in closed:
        whole = whole.unionByName(part)
    number = lambda c: F.floor(F.unix_seconds(c) / 86400).cast("int").alias(c)
    return whole.select("place_id", *FIELDS, number("valid_from"), number("valid_to"))


# --- duplicates across queries ------------------------------------------------------------------------------------------

KEYS = ["place_id", "phone", "url"]
PRIORITY = ["BUILDING in ASIA", "MACHINERY in EUROPE", "BUILDING in AFRICA", "FURNITURE in AMERICA"]
MERGED = {"business_name": "longest", "phone": "priority", "website": "latest", "email": "priority", "average_rating": "greatest", "total_reviews": "greatest"}
ROWS = "l AS (SELECT *, (seq * 7919) % 1009 AS collected, regexp_replace(regexp_replace(maps_url, '[?#].*$', ''), '/+$', '') AS url FROM leads)"
KEY_VALUES = "k AS (" + " UNION ALL ".join(f"SELECT seq, '{k}' AS t, {k} AS v FROM l WHERE {k} <> ''" for k in KEYS) + ")"
COMPONENTS = f"{ROWS}, {KEY_VALUES}, e AS (SELECT DISTINCT a.seq AS a, b.seq AS b FROM k a JOIN k b USING (t, v)), reach AS (SELECT seq AS node, seq AS root FROM l UNION SELECT e.b, root FROM reach JOIN e ON e.a = node), c AS (SELECT node AS seq, min(root) AS component FROM reach GROUP BY node), lc AS (SELECT * FROM l JOIN c USING (seq))"
RANK = "CASE source_query " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(PRIORITY)) + f" ELSE {len(PRIORITY)} END"
BY = {"priority": f"{RANK}, -collected", "latest": f"-collected, {RANK}", "longest": f"-length(CAST({{0}} AS VARCHAR)), {RANK}", "greatest": f"-{{0}}, {RANK}"}
FIRST = ", ".join(f"first({f} ORDER BY {BY[r].format(f)}, seq) FILTER (CAST({f} AS VARCHAR) <> '') AS {f}, first(seq ORDER BY {BY[r].format(f)}, seq) FILTER (CAST({f} AS VARCHAR) <> '') AS {f}_seq" for f, r in MERGED.items())


def collected(df: DataFrame) -> DataFrame:
    return df.withColumns({"collected": F.col("seq") * 7919 % 1009, "url": normalize_url(F.col("maps_url"))})


@on_leads("cross_query_dedup")
def _(df):
    return linking.cross_query_dedup(collected(df), KEYS, MERGED, "source_query", PRIORITY, "collected", scratch(df.sparkSession))


@on_leads("duplicate_report")
def _(df):
    return linking.duplicate_report(linking.link(collected(df), KEYS, scratch(df.sparkSession)).checkpoint(), KEYS, "source_query")


def _report_sql() -> str:
    parts = [f"n_{k} AS (SELECT component, {k} AS v, count(*) AS n FROM lc WHERE {k} <> '' GROUP BY 1, 2), r_{k} AS (SELECT component, count(*) AS {k}_values, CAST(count_if(n > 1) AS BIGINT) AS {k}_shared, sum(n) FILTER (n > 1) AS {k}_rows, first(v ORDER BY n DESC, v) FILTER (n > 1) AS {k}_top, max(n) FILTER (n > 1) AS {k}_top_rows FROM n_{k} GROUP BY component)" for k in KEYS]
    columns = ", ".join(f"coalesce({k}_values, 0) AS {k}_values, coalesce({k}_shared, 0) AS {k}_shared, CAST(coalesce({k}_rows, 0) AS BIGINT) AS {k}_rows, {k}_top, coalesce({k}_top_rows, 0) AS {k}_top_rows" for k in KEYS)
    joins = " ".join(f"LEFT JOIN r_{k} USING (component)" for k in KEYS)
    return f"{', '.join(parts)}, s AS (SELECT component, count(*) AS rows, count(DISTINCT source_query) AS sources FROM lc GROUP BY component HAVING count(*) > 1) SELECT component, rows, sources, {columns} FROM s {joins}"


def _recursive(sql: str) -> str:
    from .leads import SQL

    return f"WITH RECURSIVE {SQL}, {COMPONENTS}{sql}"


ORACLE_SQL["cross_query_dedup"] = _recursive(f" SELECT component, count(*) AS rows, count(DISTINCT source_query) AS sources, {FIRST} FROM lc GROUP BY component")
ORACLE_SQL["duplicate_report"] = _recursive(", " + _report_sql())


# --- scores and flags -----------------------------------------------------------------------------------------------------

has = lambda c: f"(coalesce(trim({c}), '') <> '')"
HITS = {"email": has("email"), "phone": has("phone"), "website": has("website"), "rating": "coalesce(average_rating >= 4.0, false)", "reviews": "coalesce(total_reviews >= 50, false)", "social": f"({has('facebook')} OR {has('instagram')})", "category": "lower(category) IN ('building', 'machinery')"}
OUTREACH = {"email": 50, "phone": 10, "website": 10, "rating": 10, "reviews": 10, "social": 10, "category": 20}


def _score_sql(weights: dict) -> str:
    total = sum(weights.values())
    return "round(" + " + ".join(f"CASE WHEN {HITS[s]} THEN CAST({round(100 * w / total, 4)} AS DOUBLE) ELSE 0 END" for s, w in weights.items()) + ", 2)"


FLAGS = {"no_email": f"NOT {HITS['email']}", "no_phone": f"NOT {HITS['phone']}", "no_website": f"NOT {HITS['website']}", "rating_out_of_range": "coalesce(average_rating NOT BETWEEN 0 AND 5, false)", "rated_without_reviews": "coalesce(average_rating > 0 AND coalesce(total_reviews, 0) = 0, false)", "no_place_id": f"NOT {has('place_id')}"}
SCORED = f""", s AS (SELECT *, {_score_sql(score.WEIGHTS)} AS score, {_score_sql(OUTREACH)} AS outreach,
    {" || ".join(f"CASE WHEN {HITS[s]} THEN '{s};' ELSE '' END" for s in score.WEIGHTS)} AS reasons, {" || ".join(f"CASE WHEN {c} THEN '{f};' ELSE '' END" for f, c in FLAGS.items())} AS flags FROM leads)"""


@on_leads("lead_scores", f"{SCORED} SELECT seq, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS score_grade, outreach, reasons, flags FROM s")
def _(df):
    """Scores with the default weights and with those of a campaign by e-mail, with the signals that count."""
    of = ["Building", "Machinery"]
    scored = score.score_leads(df, categories=of)
    campaign = score.points(score.signals(of), OUTREACH)
    joined = lambda c: F.concat_ws("", F.transform(c, lambda x: F.concat(x, F.lit(";"))))
    return scored.select("seq", "score", "score_grade", F.round(sum(campaign.values(), F.lit(0.0)), 2).alias("outreach"), joined(F.col("score_reasons.signal")).alias("reasons"), joined(F.col("flags")).alias("flags"))


@on_leads("quality_flags", f"{SCORED} SELECT country, f AS flag, count(*) AS leads FROM (SELECT country, unnest(string_split(rtrim(flags, ';'), ';')) AS f FROM s WHERE flags <> '') GROUP BY country, f")
def _(df):
    return score.flag_counts(score.score_leads(df), "country")
