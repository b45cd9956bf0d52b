"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; the driver, or :func:`run`, writes it as
Parquet and hands the table read back to the next stage.  All stages but the last return the columns
of their input:

1. documents that the quality rules reject go;
2. lines that repeat an earlier line of the corpus, or nearly, go; documents stay;
3. of each group of near-duplicate documents the one with the smallest ``doc_id`` stays (nulls last,
   of equal ids the first row);
4. secret parts of texts are masked;
5. what is left is tokenised and packed into sequences.

``n_chars`` follows the text.  A null text stays null through all stages; it has one token.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import linededup, packing, quality, secretscan, simhash
from tallyframe.llm.common import ROW, aside, documents, table, with_row, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = aside(docs)
    numbered = with_row(plain)
    found = simhash.components(numbered, keep=("doc_id", ROW), root=True)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", ROW)).alias("best")
    stays = found.groupBy("root").agg(best).select(F.col(f"best.{ROW}").alias(ROW))
    return numbered.join(stays, ROW, "left_semi").drop(ROW).withColumnsRenamed(back)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secretscan.redacted(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Line dedup, SimHash and tokenisation have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
