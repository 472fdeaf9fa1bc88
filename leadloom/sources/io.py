"""Readers and writers of business records.  All paths go through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import resolve_query
from ..operators.flatten import flatten_business, flatten_generic, lead_objects, prune_empty
from ..operators.rules import query_leads
from ..plans.scratch import scratch
from .schema import BUSINESS, CORRUPT, EXTRA

BOM = "\ufeff"
#: CSV doubles quotes inside quoted values.
QUOTE = "\""


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line with text is a record by itself: an object that is no envelope.  An empty file has lines."""
    line = F.trim("value")
    envelope = F.try_variant_get(F.try_parse_json("value"), "$.businesses", "variant").isNotNull()
    row = spark.read.text(path).where(line != "").select(line.startswith("{") & line.endswith("}") & ~envelope).limit(1).first()
    return row[0] if row else True


def _records(lines: DataFrame, schema: str, extra: bool) -> DataFrame:
    """Records of lines(value, ...), without those that are no object; with `extra` their unknown keys, too."""
    record = F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    more = {EXTRA: unknown_keys(F.col("value"), schema)} if extra else {}
    more |= {c: F.col(c) for c in lines.columns if c != "value"}
    rows = lines.where("trim(value) like '{%'").select(record.alias("r"), *[c.alias(k) for k, c in more.items()])
    return rows.where(f"r.{CORRUPT} is null").select("r.*", *more).drop(CORRUPT)


def unknown_keys(value: Column, schema: str = BUSINESS) -> Column:
    """A map of the keys of a JSON object that the schema does not name, and of those of its nested records."""
    as_map = lambda c: F.from_json(c, "map<string,string>")
    fields = T.StructType.fromDDL(schema).fields
    rest = lambda m, names: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(names))
    parts = [rest(as_map(value), [f.name for f in fields])]

    def inner(name: str, names: list[str]) -> Column:
        found = rest(as_map(F.get_json_object(value, f"$.{name}")), names)
        return F.transform_keys(found, lambda k, _: F.concat(F.lit(name + "."), k))

    parts += [inner(f.name, f.dataType.names) for f in fields if isinstance(f.dataType, T.StructType)]
    return F.map_concat(*parts)


def read_jsonl(spark: SparkSession, path: str, schema: str = BUSINESS, extra: bool = False) -> DataFrame:
    """One record per line; lines that are no record are dropped, blank lines are no lines."""
    return _records(spark.read.text(path).select("value"), schema, extra)


def count_bad_lines(spark: SparkSession, path: str) -> int:
    """Lines that are no JSON object."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.where(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")).count()


def read_leads(spark: SparkSession, path: str, schema: str = BUSINESS, extra: bool = False) -> DataFrame:
    """A list of records, an envelope {"businesses": [...]}, one record, or JSON lines - by the form of the file.

    Only the first line with text decides between lines and the other forms, which Spark parses whole, so that the order
    and the size of an envelope's parts do not matter.  A folder should hold files of one form.  An object that is neither
    an envelope nor has a name, an empty file and values that are no objects give no rows.
    """
    if _is_lines(spark, path):
        return read_jsonl(spark, path, schema, extra)
    whole = spark.read.option("singleVariantColumn", "v").option("multiLine", True).json(path)
    many = F.coalesce(F.try_variant_get("v", "$.businesses", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    one = F.when(F.try_variant_get("v", "$.business_name", "variant").isNotNull(), F.array("v"))
    return _records(whole.select(F.explode(F.coalesce(many, one)).alias("r")).select(F.to_json("r").alias("value")), schema, extra)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_envelope(df: DataFrame, path: str, exported_at: str, **metadata: str) -> int:
    """Records as JSON lines in `path`/businesses and the envelope's metadata beside them; returns how many there are.

    An envelope in one file would pass all records through one task, so it is kept in two parts that `read_envelope` joins.
    Nothing is written when there are no records.
    """
    n = df.count()
    if n:
        df.write.mode("overwrite").json(f"{path}/businesses")
        info = {**metadata, "total_results": n, "exported_at": exported_at}
        df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in info.items()]).write.mode("overwrite").json(f"{path}/metadata")
    return n


def read_envelope(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    return spark.read.json(f"{path}/metadata").first().asDict(), read_jsonl(spark, f"{path}/businesses")


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.json") -> str | None:
    """The newest file of a folder, by the source's file metadata."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.orderBy(F.desc("modificationTime"), "path").first()
    return row["path"] if row else None


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query): of a CSV file with query or niche and location, else of text lines without blanks and # comments."""
    if path.lower().endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
        get = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        named = F.when(get("niche").isNotNull() & get("location").isNotNull(), resolve_query(F.lit(None).cast("string"), get("niche"), get("location")))
        return rows.select(F.coalesce(F.when(F.trim(get("query")) != "", F.trim(get("query"))), named).alias("query")).where("query is not null")
    lines = spark.read.text(path).select(F.trim("value").alias("query"))
    return lines.where("query <> '' and query not like '#%'")


def export_jsonl(leads: DataFrame, path: str, **filters) -> int:
    """Stored leads that pass the filters of `query_leads`, as JSON lines with their JSON columns as objects; how many."""
    found = lead_objects(query_leads(leads, **filters))
    found.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return leads.sparkSession.read.text(path).count()


def write_table(df: DataFrame, path: str) -> None:
    """A stored table as Parquet."""
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_filtered(df: DataFrame, stem: str) -> None:
    """Nested records as JSON and the 25 named columns as CSV."""
    df.write.mode("overwrite").json(f"{stem}_filtered.jsonl")
    flatten_business(df).write.mode("overwrite").option("header", True).option("escape", QUOTE).csv(f"{stem}_filtered.csv")


def write_exported(df: DataFrame, stem: str) -> None:
    """Flattened and pruned records as CSV, with a byte order mark before the header, as spreadsheets want it."""
    flat = prune_empty(flatten_generic(df))
    flat.toDF(*[BOM * (i == 0) + c for i, c in enumerate(flat.columns)]).write.mode("overwrite").option("header", True).option("escape", QUOTE).csv(f"{stem}_exported.csv")


def write_flat_csv(df: DataFrame, path: str) -> bool:
    """CSV with nested columns as JSON text; writes nothing and returns False without rows."""
    if df.isEmpty():
        return False
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", QUOTE).csv(path)
    return True


def file_order() -> Column:
    """Where a row of a file source stands: file by file in the order of their paths, in each by place."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))


def import_jsonl(spark: SparkSession, path: str, stored: DataFrame) -> tuple[DataFrame, int, int]:
    """(stored with the file's records upserted by place id, saved, skipped); a record needs a name and a place id.

    Of records with one place id the last one wins, in the order of the files' paths and of the lines in each.  The input is
    read once: parsed records go to the shared folder for intermediate tables, where counts read two columns.  `seq` of
    stored, if it has one, numbers the lines; an empty input changes nothing.
    """
    from ..operators.dedup import upsert

    at = f"{scratch(spark).rstrip('/')}/import-{uuid.uuid4().hex}"
    _records(spark.read.text(path).select("value", file_order().alias("__place")), BUSINESS, False).write.parquet(at)
    rows = spark.read.parquet(at).withColumn("seq", F.col("__place.n"))
    fine = "business_name is not null and coalesce(place_id, '') <> ''"
    n, saved = rows.agg(F.count("*"), F.count_if(F.expr(fine))).first()
    return upsert(stored, rows.where(fine), "place_id", "__place"), saved, n - saved


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Flat rows of all graded runs under a folder of eval folders, as `run_results` gives them."""
    from ..operators.stats import run_files, run_results

    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{grading,timing,eval_metadata}.json")
    files = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return run_results(run_files(files))


def export(df: DataFrame, fmt: str = "json") -> DataFrame:
    """One JSON text per row; other formats are not known."""
    if fmt != "json":
        raise ValueError(f"unknown format: {fmt}")
    return df.select(F.to_json(F.struct("*")).alias("value"))


def output_name(query: str, stamp: str) -> str:
    """A file name for a query's results: letters that are not safe become one underscore."""
    import re

    safe = re.sub("_+", "_", re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", query)).strip("_")[:80] or "unnamed"
    return f"{safe}_{stamp}.json"
