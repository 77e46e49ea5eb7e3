"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, cotraining, divergence, fingerprints, langid, licences, line_spread, mixing, ngram_join, outliers, sharding, whitening, winnowing
from .text import whole, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_outliers(_table(spark, sf_dir, "documents"))


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = whole("text")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shard(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(langid.document_evidence(docs)).withColumnRenamed("id", "doc_id")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, where markup and addresses speak."""
    pages = _table(spark, sf_dir, "pages")
    return langid.identify(langid.page_evidence(pages)).withColumnRenamed("id", "page_id")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.line_dedup(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.size(words(whole("text"))).cast("bigint").alias("words_left"), F.md5(F.encode(whole("text"), "utf-8")).alias("text_md5"))


def op8_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_winnowed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op12_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_quality_outliers, op2_hypergeometric_shards, op3_attention_scores, op4_language_fusion, op5_source_mix, op6_winnowing,
    op7_line_spread, op8_licence_dice, op9_ngram_join, op10_cotraining, op11_winnowed_fingerprints, op12_sliced_whitening, op13_source_divergence,
    page_languages,
)

# every window of ten words (or a whole shorter item), joined with every document position
OP6_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), wins AS (
    SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
    FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (
    SELECT DISTINCT m FROM wins
), places AS (
    SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS span
    FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lens WHERE len(w) >= m)
), hits AS (
    SELECT places.r, places.m, places.i, wins.item FROM places JOIN wins USING (m, span)
), covered AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT r, m, i FROM hits)) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

OP7_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS lines FROM documents
), l AS (
    SELECT r, doc_id, source, unnest(lines) AS raw, generate_subscripts(lines, 1) AS i FROM d
), t AS (
    SELECT *, trim(raw, E' \t\n\x0b\x0c\r') AS line FROM l
), common AS (
    SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 8
), marked AS (
    SELECT t.*, common.line IS NOT NULL AS gone FROM t LEFT JOIN common USING (line)
), cleaned AS (
    SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
    FROM marked GROUP BY r
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(len(regexp_extract_all(coalesce(c.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words_left, md5(coalesce(c.text, '')) AS text_md5
FROM d LEFT JOIN cleaned c USING (r)
"""

OP13_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), t AS (
    SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
    SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
    SELECT DISTINCT lang, source FROM d
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.total + 2 * s.v) AS p
    FROM totals g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), langs AS (
    SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(sum(c.n), 0) + 2)) // (max(l.total) + 2 * max(s.v)) AS q
    FROM kept k JOIN sizes s USING (lang) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) l USING (lang) LEFT JOIN counts c USING (lang, term)
    GROUP BY k.lang, k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), tops AS (
    SELECT s.lang, s.source, 'term' AS part, s.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
    FROM shares s JOIN langs USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_winnowing": OP6_SQL, "op7_line_spread": OP7_SQL, "op13_source_divergence": OP13_SQL}
