"""From raw documents to token counts of a mixed corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept and returns a DataFrame; `run` writes it as Parquet to the shared folder and
reads it again for the next stage.  All but the last return the columns of
`documents`.

Rows are told apart by a number of their own inside a stage, not by doc_id, so rows
with equal or null ids stay separate rows.

Defined cases: nulls, empty and very long texts, repeated rows, ties and empty
tables are handled as the operators' docstrings say; a document that the first
stage gives a score of exactly 0.3 goes; columns of any name are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import bpe_stream, jaccard, mixing, surrogates, toxicity
from paceline.llm.batches import free_names
from paceline.llm.queries import SURROGATE_KEY, tokenizer_path, toxicity_model
from paceline.llm.shared import scratch_folder

REJECT = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3."""
    model = toxicity_model(spark, docs, sf_dir)
    scored = toxicity.weigh(docs, model, keep=tuple(docs.columns))
    return scored.where(F.col(scored.columns[-1]) < REJECT).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of smallest doc_id (null last; of equal ids any); rows without a word stay."""
    folder = scratch_folder(spark, "jaccard")
    row = free_names(docs.columns, ["row"])[0]
    docs.withColumn(row, F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    n_buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = jaccard.near_duplicates(rows, folder, n_buckets, row=row)
    dropped = found.where("NOT leads").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    replaced = surrogates.anonymize(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.when(F.col(replaced.columns[len(docs.columns)]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return replaced.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, once, up to three times); rows with equal or null ids are taken one by one."""
    folder = scratch_folder(spark, "mix")
    row, same, copies, turn = free_names(docs.columns, ["row", "same", "copies", "turn"])
    docs.withColumn(row, F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    sized = mixing.with_size(rows.withColumn(same, F.xxhash64("doc_id", "source", "text")), keep=(row, same, "source"))
    sized.write.mode("overwrite").parquet(f"{folder}/row_sizes")
    mixing.with_row_keys(spark.read.parquet(f"{folder}/row_sizes"), row, same).write.mode("overwrite").parquet(f"{folder}/sizes")
    due = mixing.mix_sizes(spark.read.parquet(f"{folder}/sizes"), folder, keep=(row,)).where("copies > 0")
    taken = rows.join(due.select(row, F.col("copies").cast("int").alias(copies)), row)
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe_stream.encode_decode(docs, tokenizer_path(), keep=("doc_id", "source", "lang"))


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_duplicates),
    ("PII", with_surrogates),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokenized),
]

#: The stages can't be written in SQL (learned weights, keyed permutations, merges); tests check the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    folder = scratch_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
