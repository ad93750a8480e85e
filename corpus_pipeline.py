"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination and tokens, over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what each keeps as Parquet and gives it
to the next. All stages but the last return the columns of documents. A document whose lines all go stays, with an
empty text, as line dedup rejects lines and not documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import byte_bpe, decontaminate, line_dedup, near_dup, quality
from palimpsest.llm.queries import tokenizer_file
from palimpsest.llm.store import Store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where(F.col("quality.kept")).select(*docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the token ids, and whether decoding gives the text's bytes back."""
    encoded = byte_bpe.encode(docs.select("doc_id", "source", "lang", "text"), *tokenizer_file())
    return byte_bpe.decode(encoded, *tokenizer_file()).select(
        "doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", unique_lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Tokens are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
