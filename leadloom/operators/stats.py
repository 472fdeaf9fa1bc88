"""Grouped statistics over runs and leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked, running
from .skew import unique_join


def metric_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, sample deviation (0 for one value), minimum and maximum of each group, to four places."""
    return df.groupBy(*by).agg(
        F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("stddev"),
        F.round(F.min(value), 4).alias("min"), F.round(F.max(value), 4).alias("max"),
    )


def config_delta(df: DataFrame, config: str, value: str, first: str, second: str) -> DataFrame:
    """The difference of two configurations' means, signed and to two places."""
    mean = lambda name: F.avg(F.when(F.col(config) == name, F.col(value)))
    return df.where(F.col(config).isin(first, second)).agg(F.format_string("%+.2f", mean(first) - mean(second)).alias("delta"))


#: Metrics of a run and how the difference of two configurations is shown.
METRICS = {"pass_rate": "%+.2f", "time_seconds": "%+.1f", "tokens": "%+.0f"}


def run_summary(runs: DataFrame) -> DataFrame:
    """config, metric, mean, stddev, min, max of runs(config, pass_rate, time_seconds, tokens); missing values count as 0."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value")) for m in METRICS])
    return metric_stats(runs.select("config", F.explode(pairs).alias("p")).select("config", "p.*"), ["config", "metric"], "value")


def run_delta(summary: DataFrame) -> DataFrame:
    """(metric, delta): the means of the first configuration by name less those of the second; a missing one counts as 0."""
    configs = summary.select("config").distinct()
    ranked = summary.join(F.broadcast(configs.orderBy("config").limit(2).withColumn("__n", F.row_number().over(Window.orderBy("config")))), "config")
    mean = lambda n: F.coalesce(F.sum(F.when(F.col("__n") == n, F.col("mean"))), F.lit(0.0))
    both = ranked.groupBy("metric").agg((mean(1) - mean(2)).alias("d"))
    shown = F.coalesce(*[F.when(F.col("metric") == m, F.format_string(f, "d")) for m, f in METRICS.items()])
    return both.select("metric", shown.alias("delta"))


EXPECTATION = "array<struct<text:string,passed:boolean,evidence:string>>"
GRADING = f"summary struct<pass_rate:double,passed:long,failed:long,total:long>, timing struct<total_duration_seconds:double>, execution_metrics struct<total_tool_calls:long,output_chars:long,errors_encountered:long>, expectations {EXPECTATION}, user_notes_summary struct<uncertainties:array<string>,needs_review:array<string>,workarounds:array<string>>"


def run_files(files: DataFrame) -> DataFrame:
    """(path, grading, timing, metadata) of each graded run of files(path, content), as `run_results` takes them.

    Paths end in eval-<name>/eval_metadata.json and eval-<name>/<config>/run-<n>/grading.json or timing.json; others are not
    read.  `eval_index` is the running number of the run's eval folder by name, for folders that give no number themselves.
    """
    folder = F.regexp_extract("path", r"^(.*/)?(eval-[^/]*)/", 2)
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select("path", "content", folder.alias("__eval"), file.alias("__file")).where("__eval <> ''")
    here = lambda name: rows.where(F.col("__file") == name)
    run = F.regexp_extract("path", r"^(.*eval-[^/]*/[^/]+/run-[^/]*)/[^/]+$", 1)
    graded = here("grading.json").select("path", "__eval", run.alias("__run"), F.col("content").alias("grading")).where("__run <> ''")
    timing = here("timing.json").select(run.alias("__run"), F.col("content").alias("timing")).where("__run <> ''")
    about = here("eval_metadata.json").where(F.col("path").rlike(r"eval-[^/]*/eval_metadata\.json$")).select("__eval", F.col("content").alias("metadata"))
    evals = ranked(rows.select("__eval").distinct(), "__eval", name="eval_index")
    joined = graded.join(timing, "__run", "left").join(about, "__eval", "left").join(evals, "__eval", "left")
    return joined.select("path", "grading", "timing", "metadata", "eval_index")


def run_results(graded: DataFrame) -> DataFrame:
    """Flat rows of graded(path, grading, timing): the JSON texts of a run's grading and timing files; timing may be null.

    The path ends in eval-<id>/<config>/run-<n>/<file>.  Rows whose grading is no JSON object are dropped.  The time is that
    of the grading, else that of the timing file, whose tokens count only then; tokens of 0 give way to the characters put out.
    Where graded has `metadata` and `eval_index`, the eval's id is that of a metadata file that can be read, without one the
    index; without a metadata file it is the number in the folder's name, and the index where that has none.
    """
    rows = graded.where(F.try_parse_json("grading").isNotNull() & F.trim("grading").startswith("{"))
    more = [c for c in ("metadata", "eval_index") if c in graded.columns]
    rows = rows.select("path", F.from_json("grading", GRADING).alias("g"), F.from_json("timing", "total_duration_seconds double, total_tokens long").alias("t"), *more)
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = zero("g.timing.total_duration_seconds")
    tokens = F.nullif(F.when(own == 0, F.col("t.total_tokens")), F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    number = part(r"eval-(\d+)(?:-[^/]*)?/").try_cast("long") if more else part(r"eval-(\d+)/").try_cast("long")
    if more:
        said = F.try_variant_get(F.try_parse_json("metadata"), "$.eval_id", "long")
        number = F.when(F.col("metadata").isNotNull(), F.coalesce(said, "eval_index")).otherwise(F.coalesce(number, "eval_index"))
    return rows.select(
        number.alias("eval_id"), part(r"eval-[^/]*/([^/]+)/run-").alias("config"), part(r"/run-(\d+)").try_cast("int").alias("run_number"),
        F.coalesce("g.summary.pass_rate", F.lit(0.0)).alias("pass_rate"), *[zero(f"g.summary.{c}").alias(c) for c in ("passed", "failed", "total")],
        F.when(own == 0, F.coalesce("t.total_duration_seconds", F.lit(0.0))).otherwise(own).alias("time_seconds"),
        F.coalesce(tokens, zero("g.execution_metrics.output_chars")).alias("tokens"), zero("g.execution_metrics.total_tool_calls").alias("tool_calls"),
        zero("g.execution_metrics.errors_encountered").alias("errors"), F.coalesce("g.expectations", F.array().cast(EXPECTATION)).alias("expectations"),
        F.concat(*[F.coalesce(f"g.user_notes_summary.{c}", none) for c in ("uncertainties", "needs_review", "workarounds")]).alias("notes"),
    )


def correct_runs(df: DataFrame, *by: str) -> DataFrame:
    """correct and total of df(should_trigger, triggers, runs); runs that should not trigger are correct if they did not."""
    right = F.when(F.coalesce("should_trigger", F.lit(True)), F.col("triggers")).otherwise(F.col("runs") - F.col("triggers"))
    return df.groupBy(*by).agg(F.coalesce(F.sum(right), F.lit(0)).alias("correct"), F.coalesce(F.sum("runs"), F.lit(0)).alias("total"))


def run_counters(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts of outcomes(outcome, at): scraped, failed, retried, restarts and breaks, and scraped per hour of the time span."""
    names = {"scraped": "scraped", "failed": "failed", "retried": "retried", "restart": "restarts", "break": "breaks"}
    hours = (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 3.6e9
    n = {v: F.count_if(F.col("outcome") == k) for k, v in names.items()}
    return outcomes.groupBy(*by).agg(*[c.alias(k) for k, c in n.items()], F.round(F.coalesce(n["scraped"] / F.nullif(hours, F.lit(0.0)), F.lit(0.0)), 1).alias("per_hour"))


def filter_stats(checks: DataFrame, *by: str, seconds: int = 30) -> DataFrame:
    """total, populated and empty cells of checks(is_populated), the share that is skipped and the time that this saves."""
    total, empty = F.count("*"), F.count_if(~F.col("is_populated"))
    skip = F.coalesce(F.round(empty / F.nullif(total, F.lit(0)) * 100, 1), F.lit(0.0))
    return checks.groupBy(*by).agg(total.alias("total_cells"), (total - empty).alias("populated_cells"), empty.alias("empty_cells"), skip.alias("skip_pct"), (empty * seconds).alias("seconds_saved"))


def preview(checks: DataFrame, order: str, sample: int) -> DataFrame:
    """sampled, empty and estimated_empty from a systematic sample of `sample` rows at most: every step-th row by `order`."""
    n = checks.count()
    step = max(1, n // sample) if sample else 1
    at = F.col("__i")
    some = ranked(checks, order, name="__i").where((at % step == 0) & (at / step < sample))
    empty = F.count_if(~F.col("is_populated"))
    rate = F.coalesce(empty / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    return some.agg(F.count("*").alias("sampled"), empty.alias("empty"), F.floor(rate * n).cast("long").alias("estimated_empty"))


def trigger_rate(df: DataFrame, query: str, triggered: Column, should: Column, threshold: float = 0.5) -> DataFrame:
    rates = df.groupBy(query).agg(F.avg(triggered.cast("int")).alias("rate"), F.max(should.cast("int")).alias("should"))
    return rates.withColumn("passed", F.when(F.col("should") == 1, F.col("rate") >= threshold).otherwise(F.col("rate") < threshold))


def confusion(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts with precision and recall (1 without a denominator) and accuracy (0)."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = df.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    ratio = lambda x, n, other: F.when(n > 0, x / n).otherwise(other)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp, 1.0), "recall": ratio(tp, tp + fn, 1.0), "accuracy": ratio(tp + tn, tp + fp + fn + tn, 0.0)})


def score_class(score: Column) -> Column:
    return F.when(score >= 0.8, "good").when(score >= 0.5, "ok").otherwise("bad")


def best(df: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """The row with the greatest score of each group; of equal scores the first by `order`.

    An aggregate over (score, -order), so that groups of any size are reduced within partitions first.
    """
    return df.groupBy(*by).agg(F.max(F.struct(F.col(score), (-F.col(order)).alias("__o"))).alias("__b")).select(*by, F.col(f"__b.{score}").alias(score), (-F.col("__b.__o")).alias(order))


def stratified_split(df: DataFrame, label: str, id_: str, holdout: float, seed: int = 42) -> DataFrame:
    """df with `test`: of each stratum the rows of least hash, one at least, int(n * holdout) of them.

    Rows are ranked over the whole table by stratum and hash, so that a stratum of any size is dealt over tasks; a row's rank
    in its stratum is that less the stratum's least.  A null label is a stratum.
    """
    hashed = df.withColumns({"__h": F.xxhash64(F.col(id_), F.lit(seed)), "__label": F.concat(F.col(label).isNull().cast("string"), F.coalesce(F.col(label).cast("string"), F.lit("")))})
    rows = ranked(hashed, "__label", "__h", id_, name="__k")
    strata = rows.groupBy("__label").agg(F.min("__k").alias("__o"), F.count("*").alias("__n"))
    test = F.col("__k") - F.col("__o") < F.greatest(F.lit(1), F.floor(F.col("__n") * holdout))
    return unique_join(rows, strata, "__label").withColumn("test", test).drop("__h", "__label", "__o", "__n", "__k")


def column_widths(df: DataFrame) -> DataFrame:
    """(column, width): the longest value or header and two, 60 at most."""
    longest = df.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(df.columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.least(F.greatest(F.coalesce(F.col(f"c{i}"), F.lit(0)), F.lit(len(c))) + 2, F.lit(60)).alias("width")) for i, c in enumerate(df.columns)]))
    return longest.select(pairs.alias("p")).select("p.column", "p.width")


def streak_stop(df: DataFrame, by: str, order: str, new: str, limit: int) -> DataFrame:
    """Per group the first `order`, a long, at which `limit` events in a row brought nothing new; null if that never happens.

    Events are read in order over range partitions, so one group may hold all of them.
    """
    kind = dict(df.dtypes)[by]
    key = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))  # null is a group, too
    rows = running(df.select(key.alias("__by"), F.col(order).cast("long").alias(order), (F.col(new) > 0).alias("__new")), "__by", order, "__new")
    stop = F.min(F.when(~F.col("__new") & (F.col("since") + 1 >= limit), F.col(order)))
    return rows.groupBy("__by").agg(stop.alias("stop_at")).select(F.when(F.col("__by") != "", F.expr("substring(__by, 2)")).cast(kind).alias(by), "stop_at")
