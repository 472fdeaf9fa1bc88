"""Registered round trips: what sources and sinks write over whole tables and read again, each with its SQL.

Files go to a folder of their own under the shared one for intermediate tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats
from ..sources import io
from .queries import nested, on_leads, query, read
from .scratch import scratch


def folder(df: DataFrame) -> str:
    return f"{scratch(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"


@on_leads("jsonl_round_trip", "SELECT seq, business_name, phone, website FROM leads UNION ALL SELECT seq + 1000000000, business_name, phone, website FROM leads WHERE seq % 2 = 0")
def _(df):
    """Records written, more of them appended, and all read again as the form of the files says."""
    at, rows = folder(df), nested(df).withColumn("business_name", F.concat(F.col("seq").cast("string"), F.lit("|"), "business_name"))
    io.append_jsonl(rows.drop("seq"), at)
    io.append_jsonl(rows.where("seq % 2 = 0").withColumn("business_name", F.concat((F.col("seq") + 1000000000).cast("string"), F.lit("|"), F.split("business_name", "\\|")[1])).drop("seq"), at)
    back = io.read_leads(df.sparkSession, at)
    return back.select(F.split("business_name", "\\|")[0].cast("long").alias("seq"), F.split("business_name", "\\|")[1].alias("business_name"), F.col("contact.phone").alias("phone"), F.col("contact.website").alias("website"))


@on_leads("bad_lines", "SELECT CAST(count_if(seq % 7 = 1) AS BIGINT) AS bad, CAST(count_if(seq % 7 <> 1) AS BIGINT) AS good FROM leads")
def _(df):
    at = folder(df)
    lines = df.select(F.when(F.col("seq") % 7 == 1, F.concat(F.lit("{broken "), F.col("seq").cast("string"))).otherwise(F.to_json(F.struct("business_name", "place_id"))).alias("value"))
    lines.write.text(at)
    spark = df.sparkSession
    return spark.range(1).select(F.lit(io.count_bad_lines(spark, at)).cast("long").alias("bad"), F.lit(io.read_jsonl(spark, at).count()).cast("long").alias("good"))


@on_leads("query_list_round_trip", "SELECT CASE WHEN seq % 3 = 0 THEN source_query ELSE category || ' in ' || city END AS query, count(*) AS n FROM leads GROUP BY 1")
def _(df):
    """Query lists as CSV: a query, or a niche and a location."""
    at = folder(df) + ".csv"
    own = F.col("seq") % 3 == 0
    rows = df.select(F.when(own, F.col("source_query")).alias("query"), F.when(~own, F.col("category")).alias("niche"), F.when(~own, F.col("city")).alias("location"))
    rows.write.option("header", True).csv(at)
    return io.read_queries(df.sparkSession, at).groupBy("query").agg(F.count("*").alias("n"))


@on_leads("flat_csv_round_trip", "SELECT business_name, coalesce(phone, '') AS phone, CASE WHEN phone IS NULL THEN 0 ELSE length(phone) END AS phone_length FROM leads")
def _(df):
    """Nested columns as JSON text in CSV, read again and parsed."""
    at = folder(df)
    io.write_flat_csv(nested(df).select("business_name", "contact"), at)
    back = df.sparkSession.read.option("header", True).option("escape", io.QUOTE).csv(at)
    phone = F.coalesce(F.get_json_object("contact", "$.phone"), F.lit(""))
    return back.select("business_name", phone.alias("phone"), F.length(phone).cast("long").alias("phone_length"))


@on_leads("import_counts", "SELECT count(*) AS rows_in, CAST(count_if(place_id <> '') AS BIGINT) AS saved, CAST(count_if(coalesce(place_id, '') = '') AS BIGINT) AS skipped, count(DISTINCT place_id) FILTER (place_id <> '') AS stored FROM leads")
def _(df):
    at, spark = folder(df), df.sparkSession
    io.append_jsonl(nested(df).drop("seq"), at)
    empty = io.read_jsonl(spark, at).limit(0).withColumn("seq", F.lit(0).cast("long"))
    stored, saved, skipped = io.import_jsonl(spark, at, empty)
    return stored.agg(F.count("*").alias("stored")).select(F.lit(saved + skipped).cast("long").alias("rows_in"), F.lit(saved).cast("long").alias("saved"), F.lit(skipped).cast("long").alias("skipped"), "stored")


@query("run_tree", """WITH r AS (SELECT *, 'eval-' || CASE WHEN e % 3 = 2 THEN 'x' || e ELSE CAST(e AS VARCHAR) END AS folder FROM (SELECT o_orderkey, o_orderkey // 8 AS e FROM orders)),
    i AS (SELECT folder, row_number() OVER (ORDER BY folder) - 1 AS i FROM (SELECT DISTINCT folder FROM r))
    SELECT CASE WHEN e % 5 = 1 THEN e + 1000000 WHEN e % 5 = 2 OR e % 3 = 2 THEN i ELSE e END AS eval_id, CASE WHEN o_orderkey % 2 = 0 THEN 'with' ELSE 'without' END AS config, CAST(o_orderkey % 8 AS INT) AS run_number,
    CAST(o_orderkey % 5 AS DOUBLE) / 4 AS pass_rate, o_orderkey % 5 AS passed, 5 - o_orderkey % 5 AS failed, CAST(5 AS BIGINT) AS total, CASE WHEN o_orderkey % 3 = 0 THEN 12.5 WHEN o_orderkey % 3 = 1 THEN 3.5 ELSE 0.0 END AS time_seconds,
    CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 10 <> 0 THEN o_orderkey % 10 ELSE 77 END AS tokens, o_orderkey % 4 AS tool_calls, CAST(0 AS BIGINT) AS errors,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'e' || o_orderkey || ':' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END END AS expectation, CAST(1 AS INT) AS notes FROM r JOIN i USING (folder)""")  # fmt: skip
def _(spark, d):
    """All twelve columns of graded runs from the files of a tree: gradings, timings and metadata, joined by their paths."""
    orders = read(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey div 8 AS e")
    at = orders.selectExpr("*", "concat('/data/runs/eval-', CASE WHEN e % 3 = 2 THEN concat('x', e) ELSE cast(e as string) END) AS folder")
    run = at.selectExpr("*", "concat(folder, '/', CASE WHEN o_orderkey % 2 = 0 THEN 'with' ELSE 'without' END, '/run-', o_orderkey % 8) AS run")
    grading = run.selectExpr("concat(run, '/grading.json') AS path", """concat('{"summary":{"pass_rate":', cast(o_orderkey % 5 as double) / 4, ',"passed":', o_orderkey % 5, ',"failed":', 5 - o_orderkey % 5, ',"total":5},',
        CASE WHEN o_orderkey % 3 = 0 THEN '"timing":{"total_duration_seconds":12.5},' ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('"expectations":[{"text":"e', o_orderkey, '","passed":', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"evidence":"v"}],') END,
        '"execution_metrics":{"total_tool_calls":', o_orderkey % 4, ',"output_chars":77},"user_notes_summary":{"needs_review":["a"]}}') AS content""")  # fmt: skip
    timing = run.where("o_orderkey % 3 <> 2").selectExpr("concat(run, '/timing.json') AS path", """concat('{"total_duration_seconds":3.5,"total_tokens":', o_orderkey % 10, '}') AS content""")
    about = at.where("e % 5 in (1, 2)").selectExpr("concat(folder, '/eval_metadata.json') AS path", """CASE WHEN e % 5 = 2 THEN '{broken' ELSE concat('{"eval_id":', e + 1000000, '}') END AS content""").distinct()
    out = stats.run_results(stats.run_files(grading.unionByName(timing).unionByName(about)))
    first = F.element_at("expectations", 1)
    shown = F.when(F.size("expectations") > 0, F.concat(first["text"], F.lit(":"), first["passed"].cast("string")))
    return out.select(*[c for c in out.columns if c not in ("expectations", "notes")], shown.alias("expectation"), F.size("notes").alias("notes"))
