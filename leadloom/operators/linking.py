"""Duplicates across queries: rows linked by any of several keys, a merged record of each, and a report of the clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import filled, unique_join


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b) that has a neighbour; the component is its least node.

    Randomised contraction: in each round every node gives way to that one of itself and its neighbours that comes first in
    a random order of the round, and edges are drawn between what is left.  The expected number of nodes falls by a constant
    factor a round, chain or star, so rounds grow with the logarithm of the table.  The labels are then carried back from
    the last round to the first.  Tables of rounds are checkpoints.
    """
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    rounds: list[DataFrame] = []
    while n := now.count():
        order = lambda c, r=len(rounds): F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("node"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        to = first.select(F.col("a").alias("node"), F.least("m", order("a"))["node"].alias("to")).checkpoint()
        rounds.append(to)
        for c in ("a", "b"):
            now = unique_join(now, to.select(F.col("node").alias(c), F.col("to").alias("__to")), c, rows=n).drop(c).withColumnRenamed("__to", c)
        now = now.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    labels = rounds[-1]
    for before in reversed(rounds[:-1]):
        after = labels.select(F.col("node").alias("to"), F.col("to").alias("__last"))
        labels = unique_join(before, after, "to", "left").select("node", F.coalesce("__last", "to").alias("to")).checkpoint()
    least = labels.groupBy("to").agg(F.min("node").alias("least"), F.min("to").alias("own"))
    least = least.select("to", F.least("least", "own").alias("component"))
    return unique_join(labels, least, "to").select("node", "component")


def key_edges(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """(a, b): each row of rows(seq, key) with the first row of its key, a star of edges for each key; null keys link nothing."""
    side = rows.select(F.col(seq).alias("b"), F.col(key).alias("__k"))
    first = side.groupBy("__k").agg(F.min("b").alias("a"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return unique_join(side, first, "__k").where("a <> b").select("a", "b")


def label(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """`link` without setting the folder for checkpoints."""
    edges = [key_edges(df.where(filled(k)).select(seq, F.col(k).cast("string").alias("__key")), "__key", seq) for k in keys]
    labels = components(reduce(DataFrame.unionByName, edges)).select(F.col("node").alias(seq), "component")
    return df.join(labels, seq, "left").withColumn("component", F.coalesce("component", F.col(seq)))


def link(df: DataFrame, keys: list[str], scratch: str, seq: str = "seq") -> DataFrame:
    """df with `component`: the least `seq` of the rows that it is linked with, over chains of equal values of any key.

    `seq` numbers the rows.  Null and empty values link nothing; a row without links is a component of its own.  A value that
    a third of all rows share is a star of edges, reduced within partitions.
    """
    df.sparkSession.sparkContext.setCheckpointDir(scratch)
    return label(df, keys, seq)


def _winner(rule: str, field: str, rank: Column, order: Column, seq: Column) -> Column:
    """An aggregate: struct(seq, value) of the row whose value stays, among rows that have one; ties go to the first row."""
    value = F.col(field)
    blank = value.isNull() | (value.cast("string") == "")
    of = lambda *by: F.min(F.when(~blank, F.struct(*[b.alias(f"b{i}") for i, b in enumerate(by)], seq.alias("seq"), value.alias("value"))))
    if rule == "priority":
        return of(rank, -order)
    if rule == "latest":
        return of(-order, rank)
    if rule == "longest":
        return of(-F.length(value), rank)
    if rule in ("greatest", "least"):
        return of(-value if rule == "greatest" else value, rank)
    raise ValueError(f"unknown rule: {rule}")


def merge_linked(linked: DataFrame, fields: dict[str, str], source: str, priority: list[str], order: str, seq: str = "seq") -> DataFrame:
    """One record of each component: component, rows, sources, and for each field its value and <field>_seq, where it is from.

    fields maps a column to the rule by which a value survives: `priority` (the source that comes first in the list, other
    sources last; of one source the latest), `latest` by `order`, `longest`, `greatest`, `least`.  Blank values never
    survive a filled one; a field without any is null.  All are aggregates with partial results, so a component that holds a
    third of all rows is reduced within its input partitions.
    """
    rank = reduce(lambda c, s: c.when(F.col(source) == s[1], s[0]), enumerate(priority), F.when(F.lit(False), len(priority))).otherwise(len(priority))
    when = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 62)))
    winners = [_winner(rule, f, rank, when, F.col(seq)).alias(f"__{f}") for f, rule in fields.items()]
    merged = linked.groupBy("component").agg(F.count("*").alias("rows"), *winners)
    sources = linked.where(filled(source)).select("component", source).distinct().groupBy("component").agg(F.count("*").alias("sources"))
    values = [c for f in fields for c in (F.col(f"__{f}.value").alias(f), F.col(f"__{f}.seq").alias(f"{f}_seq"))]
    return merged.join(sources, "component", "left").select("component", "rows", F.coalesce("sources", F.lit(0)).alias("sources"), *values)


def duplicate_report(linked: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Per component of two rows or more: rows, sources, and of each key its distinct values, those that two rows or more
    share, the rows with such a value, and the value that most rows share (the least of several) with their number.

    Members are never collected: rows are counted by component and value, and these counts by component.
    """
    sizes = linked.groupBy("component").agg(F.count("*").alias("rows")).where("rows > 1")
    sources = linked.where(filled(source)).select("component", source).distinct().groupBy("component").agg(F.count("*").alias("sources"))
    out = sizes.join(sources, "component", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    for k in keys:
        n = linked.where(filled(k)).groupBy("component", F.col(k).cast("string").alias("v")).agg(F.count("*").alias("n"))
        shared = F.col("n") > 1
        top = F.min(F.when(shared, F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))))
        of = n.groupBy("component").agg(
            F.count("*").alias(f"{k}_values"), F.count_if(shared).alias(f"{k}_shared"), F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias(f"{k}_rows"), top.alias("__top"))
        of = of.select("component", *[c for c in of.columns[1:-1]], F.col("__top.v").alias(f"{k}_top"), (-F.col("__top.n")).alias(f"{k}_top_rows"))
        out = out.join(of, "component", "left")
    counts = {f"{k}_{c}": F.coalesce(f"{k}_{c}", F.lit(0)) for k in keys for c in ("values", "shared", "rows", "top_rows")}
    return out.withColumns(counts)


def cross_query_dedup(df: DataFrame, keys: list[str], fields: dict[str, str], source: str, priority: list[str], order: str, scratch: str) -> DataFrame:
    """The merged records of df: rows of any query that share a key are one record."""
    linked = link(df, keys, scratch).checkpoint()
    return merge_linked(linked, fields, source, priority, order)


