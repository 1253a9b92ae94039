"""One digest query per operator of this subpackage, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, collocations, htmlregion, jaccard, langmask, mixing, quality, repetition, surrogates, syncmers, token_counts, toxicity, whitening
from .shared import scratch_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = repetition.repetition_rules(_table(spark, sf_dir, "documents"))
    repeat = F.col("dup_8gram_words")
    failed = (F.col("n_words") < 20) | (100 * repeat > 30 * F.col("n_words"))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & F.col("repetition_ok")).alias("kept"),
        "dup_5gram_chars", "dup_10gram_chars", "dup_line_chars",
    )


#: The key of the surrogates; a real run passes its own.
SURROGATE_KEY = "paceline"


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.anonymize(docs, SURROGATE_KEY).select("doc_id", "text", "n_entities", "kinds")


def _part(key: str, parts: int) -> F.Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts))


def op3_langmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_part("doc_id", 3) == 1, F.lit(False))
    model = langmask.fit(docs.where(~held))
    return langmask.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(_table(spark, sf_dir, "documents"))


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), scratch_folder(spark, "mix"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op7_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return htmlregion.extract(pages, htmlregion.learn(pages))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    held = F.coalesce(_part("doc_id", 4) == 2, F.lit(False))
    return toxicity.learn(docs, _table(spark, sf_dir, "labels").where(~held))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_part("doc_id", 4) == 2, F.lit(False))
    scored = toxicity.weigh(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_clauses")


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = F.coalesce(_part("doc_id", 5) == 0, F.lit(False))
    scored = quality.score(docs, quality.fit(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), scratch_folder(spark, "jaccard"), n_buckets)


#: A document of more tokens is over the limit.
TOKEN_LIMIT = 2048


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), scratch_folder(spark, "tokens"), n_buckets)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), scratch_folder(spark, "whitening"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return collocations.collocations(_table(spark, sf_dir, "documents"), scratch_folder(spark, "phrases"), n_buckets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repetition, op2_surrogates, op3_langmask, op4_bpe_stream, op5_syncmers, op6_pivotal_mix, op7_html_region, op8_toxicity, op9_subword_quality, op10_jaccard_join, op11_token_counts, op12_whitening, op13_collocations)}


#: Every phrase of 1 to 3 words is counted, its weakest cut scored and the phrases of a longer one dropped.
_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed
), grams AS (
  SELECT lang, 1 AS size, w[i] AS w1, NULL AS w2, NULL AS w3 FROM places
  UNION ALL SELECT lang, 2, w[i], w[i + 1], NULL FROM places WHERE i < len(w)
  UNION ALL SELECT lang, 3, w[i], w[i + 1], w[i + 2] FROM places WHERE i + 1 < len(w)
), f AS (
  SELECT lang, size, concat_ws(' ', w1, w2, w3) AS phrase, w1, w2, w3, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 10
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang
), cuts AS (
  SELECT x.*, 1 AS k, p.a AS l, s.a AS r FROM f x
  JOIN f p ON p.lang = x.lang AND p.phrase = x.w1 JOIN f s ON s.lang = x.lang AND s.phrase = concat_ws(' ', x.w2, x.w3) WHERE x.size > 1
  UNION ALL
  SELECT x.*, 2, p.a, s.a FROM f x
  JOIN f p ON p.lang = x.lang AND p.phrase = concat_ws(' ', x.w1, x.w2) JOIN f s ON s.lang = x.lang AND s.phrase = x.w3 WHERE x.size = 3
), best AS (
  SELECT *, 1000000 * a * a // (l * r) AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY 1000000 * a * a // (l * r), k) = 1
), inner_parts AS (
  SELECT lang, concat_ws(' ', w1, w2) AS phrase, a FROM f WHERE size = 3 UNION ALL SELECT lang, concat_ws(' ', w2, w3), a FROM f WHERE size = 3
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_collocations": _COLLOCATIONS}
