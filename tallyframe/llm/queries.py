"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, chat, exactdedup, infilling, langid, licensescan, linededup, packing, quality, secretscan, sentencepieces, simhash, suffixdedup)
from .common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.held_out(F.col("doc_id"))
    found = langid.predict(docs, langid.train(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(table(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.groups(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", (F.col(exactdedup.ROW) == F.col("keep_row")).alias("kept"), "text_sha256")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensescan.scan(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(documents(spark, sf_dir))


def op12_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_langid, op2_linededup, op3_packing, op4_sentencepiece, op5_chat, op6_quality, op7_exactdedup, op8_secrets, op9_licenses, op10_simhash,
    op11_infilling, op12_suffixdedup, op13_alignment)}

ORACLE: dict[str, str] = {"op6_quality": quality.ORACLE, "op7_exactdedup": exactdedup.ORACLE, "op11_infilling": infilling.ORACLE}
