"""The registered queries of the operators, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

TOXIC_LIMIT = QUALITY_LIMIT = 0.3


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_fold(scored: DataFrame, n: int, held: int, limit: float) -> DataFrame:
    return scored.select("doc_id", (fold("doc_id", n) == held).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_classifier

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return with_fold(quality_classifier(table(spark, sf_dir, "documents"), labels, fold("doc_id", 5) != 0), 5, 0, QUALITY_LIMIT)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules, trusted_ids

    return quality_rules(table(spark, sf_dir, "documents"), good=trusted_ids(table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return with_fold(toxicity(table(spark, sf_dir, "documents"), labels, fold("doc_id", 4) != 2), 4, 2, TOXIC_LIMIT)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import score_documents

    return score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import url_filters

    return url_filters(table(spark, sf_dir, "pages"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vafile import centroid_clustering

    return centroid_clustering(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_minhash_near_dedup, op3_quality_rules, op4_html_extraction, op5_token_counts, op6_toxicity, op7_lm_scoring, op8_exact_dedup, op9_packing, op10_bpe_round_trip, op11_spelling_variants, op12_url_filters, op13_centroid_clustering)}

def _kmeans_sql(rounds: int = 10, k: int = 8) -> str:
    """Rounds of assignment and replacement, one common table expression each."""
    near = "SELECT i, v, CAST(c AS INTEGER) AS c, c_v, d FROM (SELECT x.i, x.v, c{0}.c, c{0}.v AS c_v, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(x.v, c{0}.v)]) AS d FROM x, c{0}) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1"
    sql = f"""WITH kept AS (SELECT vec_id, [CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = 64),
        x AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, v FROM kept),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM x ORDER BY sha256('3:' || vec_id), v LIMIT {k})"""
    for r in range(rounds):
        sql += f""",
        a{r} AS MATERIALIZED ({near.format(r)}),
        s{r} AS (SELECT c, d, floor_sum // n - CASE WHEN floor_sum % n < 0 THEN 1 ELSE 0 END AS m FROM (SELECT c, d, CAST(sum(e) AS BIGINT) AS floor_sum, count(*) AS n FROM (SELECT c, unnest(range(64)) AS d, unnest(v) AS e FROM a{r}) GROUP BY c, d)),
        c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, list(m ORDER BY d) AS v FROM s{r} GROUP BY c) m ON m.c = c{r}.c)"""
    return sql + f""",
        a AS MATERIALIZED ({near.format(rounds)})
        SELECT vec_id, a.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c_v, ',')) AS centroid_sha256 FROM a JOIN x USING (i)"""


ORACLE_SQL = {
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    # canonical links and refreshes with absolute urls and attributes in the usual order; the rules in order of length
    "op12_url_filters": r"""
        WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
        found AS (SELECT url AS a, coalesce(nullif(regexp_extract(html, '<link rel="canonical" href="([^"]*://[^"]*)"', 1), ''),
            nullif(regexp_extract(html, '<meta http-equiv="refresh" content="[0-9]+; *url=([^"]*://[^"]*)"', 1), '')) AS b FROM p WHERE url LIKE '%://%'),
        ends AS (SELECT a, b FROM found WHERE b IS NOT NULL UNION SELECT b, a FROM found WHERE b IS NOT NULL),
        u AS (SELECT url FROM p UNION SELECT a FROM ends),
        cut AS (SELECT url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(url, '#(?s:.*)$', '') AS node FROM u),
        rules(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        fits AS (SELECT DISTINCT ON (url) url, rh || rp AS rule, verdict FROM cut JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
            ORDER BY url, length(rh || rp) DESC, verdict),
        edge AS (SELECT x.node AS a, y.node AS b FROM ends JOIN cut x ON x.url = ends.a JOIN cut y ON y.url = ends.b),
        bad AS (SELECT node FROM cut JOIN fits USING (url) WHERE verdict = 'block' UNION SELECT b FROM bad JOIN edge ON edge.a = bad.node)
        SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN host <> '' AND node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END AS verdict
        FROM p JOIN cut USING (url) LEFT JOIN fits USING (url)""",
    "op13_centroid_clustering": _kmeans_sql(),
}
