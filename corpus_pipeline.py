"""A corpus pipeline over ``documents``: quality, toxicity, near-duplicates,
benchmark passages, tokens. Each stage works on all rows that its predecessor
kept and is written as Parquet and read again before the next."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlens.llm import common, decontam, pieces, quality, simhash, toxicity


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (shingles of 3 words, 3 bits)."""
    return simhash.drop_near_duplicates(docs, width=3, max_bits=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, pieces of the text, and whether they decode to it."""
    common.small_batches(spark)
    return docs.select("doc_id", "lang", "source", "n_chars", pieces.encode_column("text").alias("e")).select(
        "doc_id", "lang", "source", "n_chars", F.col("e.ids").alias("ids"),
        F.when(F.col("e.ids").isNotNull(), F.size("e.ids")).alias("n_pieces"), F.col("e.lossless").alias("lossless"))


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("tokens", tokens)]

#: Three stages are models or similarity searches that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
