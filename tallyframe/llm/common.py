"""Helpers shared by the operators: inputs, scratch tables on the shared folder, package shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a regular-expression class body (fixed by the contracts).
SPACE = r"\x20\x09-\x0D"

_shipped: set[str] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="pkg-"), f"{os.path.basename(top)}_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A local session without the setting gets a temporary folder; any other session must name one,
    since executors cannot see each other's disks.
    """
    where = spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results not written elsewhere become unreadable."""
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written` that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


#: Rows of up to 40 bytes that are sent to every executor at most, about 40 MB.
FEW_ROWS = 1_000_000


def few(narrow: DataFrame) -> DataFrame:
    """Broadcast a narrow frame of fixed-size columns after counting its rows; leave a larger one to shuffle."""
    return F.broadcast(narrow) if narrow.count() <= FEW_ROWS else narrow


#: Columns that operators add to the caller's while they work: the row number, and the lines that go.
ROW, GONE = "__row", "__gone"


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of those names renamed, and the names to give back at the end."""
    taken = {c.lower() for c in docs.columns}
    back = {}
    for c in docs.columns:
        if c.lower() in (ROW, GONE):
            free = next(n for i in range(len(taken) + 1) if (n := f"{c}_{i}").lower() not in taken)
            taken.add(free.lower())
            back[free] = c
    return docs.withColumnsRenamed({c: free for free, c in back.items()}), back


def with_row(docs: DataFrame) -> DataFrame:
    """Add a number for each row, the same each time the frame is read within the application.

    Numbers follow the input splits.  Their size would follow the cores that are there when a read is
    planned, and so change when an executor is lost; it is therefore pinned for the session (only
    if nobody has set it).  A frame that is more than a scan with columns and filters is written first.
    """
    spark = docs.sparkSession
    if spark.conf.get(_MIN_SPLITS, None) is None:
        spark.conf.set(_MIN_SPLITS, str(spark.sparkContext.defaultParallelism))
    plan = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    if not all(re.match(r"[\s:+-]*(Relation|LocalRelation|Project|Filter)\b", line) for line in plan):
        docs = written(docs, "numbered")
    return docs.withColumn(ROW, F.monotonically_increasing_id())


_MIN_SPLITS = "spark.sql.files.minPartitionNum"


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each run of equal first ``keys`` columns."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and r[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held
