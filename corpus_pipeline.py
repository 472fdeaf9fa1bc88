"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
The last stage returns pieces of packed sequences, all others return the columns of documents, in their order, whatever
further columns there are.  The two filters judge each row where it lies.  The two stages on copies send ids, digests and
signatures through Spark and take the dropped ids out of the texts at last: by a broadcast of at most SMALL_IDS ids, or by
a merge join where there are more.

Nulls: a null text is an empty one, which the quality rules reject.  A row with a null doc_id is judged by its text like
any other and has no link to copies: exact dedup drops it only if a row with an id has its text, near dedup keeps it.
Rows with one id are judged each by its own text; in near dedup they stay or go together.  Repeated rows, of one id and
one text, go on once from exact dedup on.  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import fold, materialize, sized, table

#: Documents with a quality score below this are rejected.
QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a quality score of QUALITY or more, learnt from the training folds of the labels.

    Ties at the limit are kept.  Without any label all rows are kept.
    """
    from leadloom.llm.quality import good_documents

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return good_documents(docs, labels, fold("doc_id", 5) != 0, QUALITY)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the likelihood ratio against the documents labelled as good."""
    from leadloom.llm.rules import kept_documents, trusted_ids

    return kept_documents(docs, trusted_ids(table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, but for the case of A-Z, the one with the largest id; null ids as said above."""
    from leadloom.llm.exact_dedup import digest
    from leadloom.llm.exact_dedup import exact_dedup as dedup

    found = dedup(docs).where("doc_id is not null or keep_id is not null")
    dropped = materialize(found.where("not kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest")).distinct(), "dropped")
    repeated = materialize(found.where("kept").groupBy(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest")).count().where("count > 1").drop("count"), "repeated")
    named = docs.where("doc_id is not null").join(sized(dropped), (F.col("doc_id") == F.col("__id")) & (digest() == F.col("__digest")), "left_anti")
    bare = docs.where("doc_id is null").join(sized(dropped.where("__id is null")), digest() == F.col("__digest"), "left_anti")
    if not repeated.isEmpty():
        again = (F.col("doc_id") == F.col("__id")) & (digest() == F.col("__digest"))
        once = named.join(sized(repeated), again, "left_semi").withColumn("__key", digest()).dropDuplicates(["doc_id", "__key"]).drop("__key")
        named = named.join(sized(repeated), again, "left_anti").unionByName(once)
    return named.unionByName(bare).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id."""
    from leadloom.llm.minhash import near_dedup as dedup

    found = dedup(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("stays"))
    dropped = materialize(found.where("not stays").select("__id"), "dropped")
    return docs.join(sized(dropped), F.col("doc_id") == F.col("__id"), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, as `leadloom.llm.packing.pack` returns them."""
    import public_tokenizers

    from leadloom.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("packing", packing)]

#: The classifier, the hashed likelihood ratio and the packing cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
