"""Exact deduplication by distributed MSD radix partitioning.

The radix key of a document is its normalised text in bytes, with the byte length in front, so that
documents of a group end together.  Round by round, groups are split by the next bytes (64, then
eight times as many each round) until a group is a single document, which leaves, or ends, which
makes its documents equal.  Equality is decided on the bytes themselves; no digest is compared.

A round groups rows by (group, next bytes) with map-side counting, keeps the groups of two or more
and joins them back.  So a group of copies that holds a third of all rows is one row per map task in
the aggregation, and a hot key on the row side of a join with unique keys on the other side, which
adaptive execution splits.  Texts are moved only for documents that share length and first bytes
with another one.

Defined cases: a null text counts as empty.  Of equal texts the row with the smallest ``doc_id``
stays (nulls last; of repeated ``doc_id`` the first row read).  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACE, aside, few, with_row, written

FIRST = 64
WIDER = 8


def normalised(text: str) -> str:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), f"[{SPACE}]+", " ")


def groups(docs: DataFrame, first: int = FIRST, wider: int = WIDER, numbered: bool = False) -> DataFrame:
    """``doc_id``, the row number (that of ``docs``, if it is ``numbered``), ``text_sha256, keep_id, keep_row, group_size`` for every row of ``docs``."""
    rows = (docs if numbered else with_row(docs.select("doc_id", "text"))).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = normalised("text")
    raw = text.cast("binary")
    heads = written(rows.select(ROW, "doc_id", F.octet_length(text).alias("size"), F.substring(raw, 1, first).alias("head"),
                                F.sha2(text, 256).alias("text_sha256")), "exact-heads")
    shared = heads.groupBy("size", "head").agg(F.count("*").alias("n"), F.min(ROW).alias("grp")).where("n > 1").drop("n")
    found = written(heads.join(shared, ["size", "head"]).select(ROW, "size", "grp"), "exact-0")
    ended = [found.where(F.col("size") <= first).select(ROW, "grp")]
    open_ = found.where(F.col("size") > first)
    # the remaining bytes of the documents that share their first ones
    rest = rows.join(few(open_), ROW).select(ROW, "size", "grp", F.expr(f"substring(cast({_sql()} as binary), {first + 1})").alias("rest"))
    part, at, width = written(rest, "exact-rest"), first, first * wider
    while not part.isEmpty():
        chunk = F.substring("rest", 1, width)
        alike = part.groupBy("grp", chunk.alias("chunk")).agg(F.count("*").alias("n"), F.min(ROW).alias("next")).where("n > 1").drop("n")
        split = part.withColumn("chunk", chunk).join(alike, ["grp", "chunk"])
        at += width
        done = F.col("size") <= at
        split = split.select(ROW, "size", F.col("next").alias("grp"),
                             F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest"))
        after = written(split, f"exact-{at}")
        ended.append(after.where(done).select(ROW, "grp"))
        part, width = after.where(~done), width * wider
    equal = ended[0]
    for e in ended[1:]:
        equal = equal.unionAll(e)
    whole = heads.select(ROW, "doc_id", "text_sha256").join(equal, ROW, "left")
    whole = written(whole.select(ROW, "doc_id", "text_sha256", F.coalesce("grp", ROW).alias("grp")), "exact-groups")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("keep_id"), F.col(ROW).alias("keep_row"))).alias("best")
    sizes = whole.groupBy("grp").agg(F.count("*").alias("group_size"), best)
    return whole.join(sizes, "grp").select("doc_id", ROW, "text_sha256", "best.keep_id", "best.keep_row", "group_size")


def _sql() -> str:
    return f"regexp_replace(coalesce(text, ''), '[{SPACE}]+', ' ')".replace("\\", "\\\\")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay."""
    plain, back = aside(docs)
    rows = with_row(plain)
    kept = groups(rows, numbered=True).where(F.col(ROW) == F.col("keep_row")).select(ROW)
    return rows.join(kept, ROW, "left_semi").drop(ROW).withColumnsRenamed(back)


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as x from documents),
     g as (select x, min(doc_id) as keep_id, count(*) as group_size from t group by x)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.x) as text_sha256
from t join g using (x)
"""
