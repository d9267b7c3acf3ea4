"""The registered queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumifuzz.llm import bpe, castore, common, decontam, divergence, fastsketch, licenses, linequality, quality, secretscan, simhash, tokencount, toxicity, whitening

TOKEN_LIMIT = 4096
END_ID = 0


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.documents(spark, sf_dir), common.tokenizer_path("word_bpe_49k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, one row each, with the benchmark items that they hold."""
    return decontam.mark(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("overlaps")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(common.documents(spark, sf_dir), common.tokenizer_path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, common.crc_mod("doc_id", 4) != 2)
    return _with_fold(toxicity.rate(docs, model), 4, 2)


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linequality.judge(common.documents(spark, sf_dir))


def op7_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = castore.write(common.documents(spark, sf_dir), common.shared_folder(spark, "store"), common.tokenizer_path("byte_bpe_50k.json"), END_ID)
    return castore.read_digests(spark, folder)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.fit(docs, labels, common.crc_mod("doc_id", 3) != 1)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_fold(quality.rate(common.documents(spark, sf_dir), quality_model(spark, sf_dir)), 3, 1)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(common.documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.documents(spark, sf_dir))


_DIVERGENCE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.LEAST_DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(max(t.n), 0) AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) t USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + {divergence.PRIOR})) // (g.n + {divergence.PRIOR} * l.v) AS p,
    1 + ({divergence.SCALE}::HUGEINT * (k.n + {divergence.PRIOR})) // (l.n + {divergence.PRIOR} * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastsketch.near_duplicates(common.documents(spark, sf_dir))


def _with_fold(rated: DataFrame, mod: int, held_out: int) -> DataFrame:
    return rated.select("doc_id", (common.crc_mod("doc_id", mod) == held_out).alias("held_out"), "score", "predicted")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_decontamination, op3_token_counts, op4_licenses, op5_toxicity, op6_line_quality, op7_content_store, op8_quality, op9_secrets, op10_simhash, op11_divergence, op12_whitening, op13_minhash)}


def llm_oracle_sql() -> dict[str, str]:
    return {"op11_divergence": _DIVERGENCE_SQL}
