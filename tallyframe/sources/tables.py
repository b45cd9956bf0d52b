"""Base-table scans, load-time code normalisation and the report sink."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Mapping
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def load(spark: SparkSession, source: str, name: str, fmt: str = "parquet",
         options: Mapping[str, str] | None = None) -> DataFrame:
    """Scan one base table.

    ``source`` is a folder holding ``<name>.parquet`` (or ``<name>`` for other file formats), or a
    JDBC URL (``jdbc:...``), in which case ``name`` is the ``schema.table`` to read.  Column pruning
    and filters are pushed to the scan by Catalyst, so callers select what they need afterwards.

    The frame is kept for the session (its file list is not read again); ``tallyframe.refresh`` drops
    it, so that files added later are seen.
    """
    opts = dict(options or {})
    from tallyframe.session import app_id
    key = (app_id(spark), source, name, fmt, tuple(sorted(opts.items())))
    cached = _LOADED.get(key)
    if cached is not None:
        return cached
    df = _load(spark, source, name, fmt, opts)
    _LOADED[key] = df
    return df


_LOADED: dict[tuple, DataFrame] = {}


def forget(spark: SparkSession, source: str | None = None) -> None:
    """Drop the kept frames of ``source`` (of all sources without it)."""
    from tallyframe.session import app_id
    app = app_id(spark)
    for key in [k for k in _LOADED if k[0] == app and source in (None, k[1])]:
        _LOADED.pop(key).unpersist()


def _load(spark: SparkSession, source: str, name: str, fmt: str, opts: dict) -> DataFrame:
    if source.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=source, dbtable=name, **opts).load()
    if fmt == "parquet":
        return spark.read.options(**opts).parquet(os.path.join(source, f"{name}.parquet"))
    return spark.read.format(fmt).options(**opts).load(os.path.join(source, name))


def rtrim_blanks(col: Column | str) -> Column:
    """T-SQL ``rtrim``: strip trailing blanks only (not tabs or line breaks)."""
    return F.rtrim(F.col(col) if isinstance(col, str) else col)


def normalise_codes(df: DataFrame, cols: Iterable[str], collation: str | None = None) -> DataFrame:
    """Right-trim blank-padded fixed-width code columns once, at load time.

    Fixed-width ``char`` codes compare equal with or without trailing blanks in the source system;
    trimming once lets every later comparison be a plain equality (and keeps parquet pushdown).
    ``collation`` (e.g. ``"UTF8_LCASE_RTRIM"``) additionally makes ``=``, ``IN`` and prefix tests on
    these columns case-insensitive, like a case-insensitive server collation (``LIKE`` patterns
    need ``UTF8_LCASE``).
    """
    if collation:
        return df.withColumns({c: F.collate(rtrim_blanks(c), collation) for c in cols})
    return df.withColumns({c: rtrim_blanks(c) for c in cols})


def write_report(df: DataFrame, path: str, mode: str = "overwrite",
                 headings: Mapping[str, str] | None = None, fmt: str = "parquet") -> None:
    """Write a report result in place, optionally renaming columns to display headings first."""
    out = df.withColumnsRenamed(dict(headings)) if headings else df
    out.write.mode(mode).format(fmt).save(path)


def publish_report(df: DataFrame, path: str, headings: Mapping[str, str] | None = None, fmt: str = "parquet",
                   as_of: str | None = None) -> None:
    """Write a report result with display headings, so that readers see a whole report or the one before.

    The result is staged beside the report and counted; then its manifest, a small file that names the
    staged folder, takes the place of the former manifest in one rename.  A job that is lost before that
    leaves the former report as it was.  ``as_of`` keeps one report per instant: only that one's manifest
    is replaced.  Staged folders that no manifest names are deleted after the next good write.
    """
    spark = df.sparkSession
    out = df.withColumnsRenamed(dict(headings)) if headings else df
    entry = _entry(as_of)
    part = f"{entry}-{uuid.uuid4().hex}"
    out.write.mode("errorifexists").format(fmt).save(f"{path}/_data/{part}")
    rows = spark.read.format(fmt).schema(out.schema).load(f"{path}/_data/{part}").count()
    told = {"part": part, "format": fmt, "rows": rows, "schema": out.schema.json()}
    fs, jvm = _file_system(spark, path), spark._jvm
    fresh, current = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/.{part}"), jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/{entry}.json")
    stream = fs.create(fresh)
    try:
        stream.write(bytearray(json.dumps(told).encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(current), options)
    kept = {t["part"] for t in _manifests(spark, path).values()}
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_data")):
        name = status.getPath().getName()
        if name not in kept and name.rsplit("-", 1)[0] == entry:
            fs.delete(status.getPath(), True)


def read_report(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """The report that :func:`publish_report` committed last (for ``as_of``)."""
    told = _manifests(spark, path).get(_entry(as_of))
    if not told:
        raise FileNotFoundError(f"no report at {path}" + (f" as of {as_of}" if as_of else ""))
    return spark.read.format(told["format"]).schema(StructType.fromJson(json.loads(told["schema"]))).load(f"{path}/_data/{told['part']}")


def report_instants(spark: SparkSession, path: str) -> list[str]:
    """The instants for which a report is committed, in order."""
    return sorted(unquote(k.removeprefix("as_of=")) for k in _manifests(spark, path) if k.startswith("as_of="))


def _entry(as_of: str | None) -> str:
    return f"as_of={quote(as_of, safe='')}" if as_of else "latest"


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> dict[str, dict]:
    """What each committed manifest says, by its entry."""
    fs, where = _file_system(spark, path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests")
    out = {}
    for status in fs.listStatus(where) if fs.exists(where) else []:
        name = status.getPath().getName()
        if name.endswith(".json") and not name.startswith("."):
            stream = fs.open(status.getPath())
            try:
                out[name.removesuffix(".json")] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
    return out
