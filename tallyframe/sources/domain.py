"""Domain tables of the reconciliation workload, derived from the driver's star-schema tables.

The reconciliation reports read a property register, bin services, bin bands, rates, rate types,
assessments, contact tables, CRM tables and a finance register.  Here each of them is a view over
the driver tables (customer, supplier, orders, lineitem, events, nation), so that every report's
work grows with those tables.  Every view keeps all rows of its source; attributes (hierarchy,
codes, statuses) are derived from key arithmetic and values, never by sampling rows.

Conventions (``k`` = ``c_custkey``, ``s`` = ``s_suppkey``):

* property ``k``; it is a *child* when ``k >= 10`` and ``k % 10`` is 1..4, its parent is
  ``k - k % 10``; a key ending in 0 is a shared-dwelling parent.
* register ids: ``tpklpaprop = 1000000 + k``, ``assessment_key = 500000 + k``,
  ``assessment = 700000 + k``.
* finance agents use negative ids (``-1 - s``) so they never collide with customer ids;
* notice group of an assessment: ``k // 15`` (the driver tables hold 15 customers a supplier), so
  groups grow with the suppliers and none grows with the data.

Every order line is a service record and every order a rate record; which of them are current
shows in their status and dates.  Every event is a request and a task; which are open bin requests
or open charge tasks shows in questionnaire and status.

Fixed-width codes (property type, rate type) are stored blank padded to 10 characters, as in the
source system; ``normalise_codes`` trims them when a report loads them.
"""

from __future__ import annotations

import hashlib
import os
import re
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.tables import forget, load, normalise_codes

# Bin bands (code, minimum, maximum, calculation method).
BIN_BANDS = [
    ("SML", 0, 100, "SNG1"), ("MED", 101, 200, "SNG1"), ("LGE", 201, 1000, "SNG1"),
    ("SML", 0, 100, "SHA1"), ("MED", 101, 200, "SHA1"), ("LGE", 201, 1000, "SHA1"),
]

# Service codes and whether each is active (R0002 deliberately absent).
SERVICE_CODES = [("R0001", "Yes"), ("G0120", "No"), ("N0120", "No"), ("N0000UA", "Yes")]

# Rate types 0-11 are class (DWS, DWM) x bin (SML, MED, LGE) x frequency (01, 02);
# 12 is the special N0000UA code, 13 a non-current DWS code, 14 another category.
_BINS = ["SML", "MED", "LGE"]
RATE_TYPES = (
    [(c * 6 + b * 2 + f, f"{cls}{_BINS[b]}0{f + 1}", "Y", "DWM")
     for c, cls in enumerate(["DWS", "DWM"]) for b in range(3) for f in range(2)]
    + [(12, "N0000UA", "Y", "DWM"), (13, "DWSSML01", "N", "DWM"), (14, "GENERAL01", "Y", "GEN")]
)

# CRM questionnaires by event_id % 5, request statuses by event_id % 3.
QUESTIONNAIRES = ["New bin", "Remove bin", "Repair or replace bin", "Upsize or downsize bin", "Other"]
CASE_STATUSES = ["Submitted", "Approved", "Closed"]

AUDIT_DATE = "1998-03-31 00:00:00"
LAST_END = "1998-01-01 00:00:00"


def _pick(index: Column, values: list[str]) -> Column:
    """``values[index]`` as a column (index 0-based, small fixed lists only)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _pad10(c: Column) -> Column:
    return F.rpad(c, 10, " ")


class Domain:
    """Lazily built domain views over one folder of driver tables."""

    # Views with a join, and the key that reports join them on.  All others are columns of one driver
    # table: deriving them in the scan costs less than writing and reading them.
    WRITTEN = {"property": "property_key", "property_services_facts": "property_key",
               "rate_type_facts": "property_key", "cnaaddr": "tpkcnaaddr"}
    # The parts whose union is a written view.  For each the driver tables that it is linear in, so that
    # files added there only add rows, and those that it also reads: a change there derives the view again.
    PARTS = {"property": [("properties", ("customer",), ("nation",))],
             "property_services_facts": [("base_services", ("customer",), ()), ("line_services", ("lineitem", "orders"), ())],
             "rate_type_facts": [("base_rates", ("customer",), ()), ("order_rates", ("orders",), ("customer",))],
             "cnaaddr": [("agent_addresses", ("supplier",), ()), ("customer_addresses", ("customer",), ("supplier",))]}
    # A view that has been added to so often is derived again as a whole, which joins its small files.
    MOST_ADDED = 16
    # A key is hot when it alone holds this many times the rows of an even bucket.
    HOT = 2
    # Tables of fewer rows are not worth buckets: their joins broadcast or shuffle little.
    BUCKETED_ROWS = 100_000

    def __init__(self, spark: SparkSession, sf_dir: str, normalise: bool = True,
                 store: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.normalise = normalise
        self.store = store
        self._views: dict[str, DataFrame] = {}
        self._tables: list[str] = []
        # what written views consist of: folders, bucketed table, and the files of driver tables behind them
        self._folders: dict[str, list[str]] = {}
        self._buckets: dict[str, str] = {}
        self._inputs: dict[object, dict[str, dict[str, tuple]]] = {}
        self._seen: dict[str, dict[str, tuple]] = {}
        self._totals: dict[tuple, str] = {}
        # the driver tables that a kept view or dataset reads; those being noted, per thread
        self._reads: dict[object, frozenset[str]] = {}
        self._noting = threading.local()
        # names of the tables written so far, in order
        self.log: list[str] = []
        # files of driver tables to read instead of all
        self._only: dict[str, list[str]] = {}
        self._locks = {name: threading.Lock() for name in VIEW_NAMES}

    def view(self, name: str) -> DataFrame:
        """The named view.  With a ``store`` folder a view with a join is written there once and read
        back, so that its join runs once and a lost executor reads a file again."""
        with self._locks[name]:
            def make() -> DataFrame:
                df = getattr(self, f"build_{name}")()
                if not (self.store and name in self.WRITTEN):
                    return df
                return self._put(name, df, self.WRITTEN[name])
            return self.noted(self._views, name, make, name in self.WRITTEN)

    def derived(self, name: str) -> DataFrame:
        """The named view for a dataset that keeps few of its rows: read back where it is written already,
        else as a plan, so that the dataset's filters reach the driver tables before these are joined."""
        return self.view(name) if name in self._views else getattr(self, f"build_{name}")()

    def noted(self, kept: dict, key: object, make: Callable[[], DataFrame], written: bool) -> DataFrame:
        """The frame kept under ``key``, made if need be.  The driver tables it reads are noted for the frame
        that is being made from it and, if it is a ``written`` one, their files for :meth:`update`."""
        outer = self._noting.__dict__.setdefault("sets", [])
        if key not in kept:
            outer.append(set())
            try:
                kept[key] = make()
            finally:
                self._reads[key] = frozenset(outer.pop())
            if self.store and written:
                self._inputs[key] = {t: self._files(t) for t in self._reads[key]}
        if outer:
            outer[-1].update(self._reads.get(key, ()))
        return kept[key]

    def _put(self, name: str, df: DataFrame, key: str | None) -> DataFrame:
        """Write a table to the store and read it back, in buckets of ``key`` where that is safe.

        Tables in as many buckets of the same key join and aggregate on it without a shuffle.  A bucket
        is read by one task, so a table with a hot key (one that fills ``HOT`` even buckets by itself)
        is left unbucketed: its joins shuffle, and adaptive execution splits the key.
        """
        path = f"{self.store}/{name}"
        self._folders[name] = []  # totals of the former folder do not count any more
        self._totals = {k: v for k, v in self._totals.items() if k[0] != name}
        if stale := self._buckets.pop(name, None):
            self._tables.remove(stale)
            self.spark.sql(f"DROP TABLE IF EXISTS {stale}")
        df.write.mode("overwrite").parquet(path)
        self.log.append(name)
        self._folders[name] = [path]
        plain = self.spark.read.parquet(path)
        if key is None or self.spark.conf.get("spark.sql.catalogImplementation", "in-memory") != "in-memory":
            return plain  # a table in a lasting catalog would outlive the session
        if (rows := plain.count()) < max(1, self.BUCKETED_ROWS):
            return plain
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self._hot(plain, key, rows, n):
            return plain
        table = "tf_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        (plain.repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key)
         .option("path", f"{path}-buckets").format("parquet").saveAsTable(table))
        self._tables.append(table)
        self._buckets[name] = table
        return self.spark.table(table)

    def _hot(self, df: DataFrame, key: str, rows: int, buckets: int) -> bool:
        """Whether a key holds more rows than ``HOT`` even buckets."""
        return df.groupBy(key).count().agg(F.max("count")).first()[0] > self.HOT * max(1, rows // buckets)

    # ---------------------------------------------------------------- added files
    def update(self) -> dict[str, str]:
        """Bring what is kept up to date with the input folder, and say what was done with each written view.

        Files are compared by name, length and time with those that a view was derived from.  A view none
        of whose driver tables changed is ``kept``.  Where files were only added, and only to tables that the view's
        parts are linear in, the rows that follow from the new files are derived and ``added`` beside the
        rest: for each such table in turn its new files with all files of the tables before it and the former
        files of those after it.  Otherwise the view is ``dropped`` and derived again on its next use, as is
        a written dataset that reads a changed table.  Frames got before may no longer be readable.
        """
        forget(self.spark, self.sf_dir)
        self._seen.clear()
        done, now = {}, {t: self._files(t) for t in sorted({t for was in self._inputs.values() for t in was})}
        same = {key for key, was in self._inputs.items() if all(was[t] == now[t] for t in was)}
        for name in [n for n in self.WRITTEN if n in self._inputs]:
            with self._locks[name]:
                was = self._inputs[name]
                if name in same:
                    done[name] = "kept"
                    continue
                linear = {t for _, own, _ in self.PARTS[name] for t in own}
                other = {t for _, _, others in self.PARTS[name] for t in others}
                only_more = all(was[t].items() <= now[t].items() for t in was)
                changed = {t for t in was if was[t] != now[t]}
                # until the addition is done the view counts as dropped
                self._views.pop(name, None)
                del self._inputs[name]
                done[name] = "dropped"
                if only_more and changed <= linear - other and len(self._folders[name]) <= self.MOST_ADDED:
                    self._views[name] = self._add(name, was, now)
                    self._inputs[name] = {t: now[t] for t in was}
                    done[name] = "added"
        # unwritten frames are plans over former lists of files
        for kept in (self._views, self.__dict__.get("_dataset_memo", {})):
            for key in [k for k in kept if k not in same and done.get(k) != "added"]:
                del kept[key]
                self._inputs.pop(key, None)
        return done

    def _files(self, table: str) -> dict[str, tuple]:
        """Length and time of each file that the kept scan of a driver table reads."""
        if table not in self._seen:
            self._seen[table] = self._listed(table)
        return self._seen[table]

    def _listed(self, table: str) -> dict[str, tuple]:
        if self.sf_dir.startswith("jdbc:"):
            return {"jdbc": (object(),)}  # equals no other listing
        plain = lambda p: re.sub(r"^file:/+", "file:/", p)
        found = self.spark.read.format("binaryFile").load(os.path.join(self.sf_dir, f"{table}.parquet"))
        known = {plain(r["path"]): (r["length"], r["modificationTime"]) for r in found.select("path", "length", "modificationTime").collect()}
        return {(p := plain(unquote(f))): known.get(p, ()) for f in self._t(table).inputFiles()}

    def _delta(self, name: str, was: dict[str, dict], now: dict[str, dict]) -> DataFrame:
        """The rows of a view that follow from the files of ``now`` but not of ``was``."""
        rows = []
        for part, own, _ in self.PARTS[name]:
            for i, table in enumerate(own):
                if new := sorted(now[table].keys() - was[table].keys()):
                    step = Domain(self.spark, self.sf_dir, self.normalise)
                    step._only = {table: new, **{t: sorted(was[t]) for t in own[i + 1:] if was[t] != now[t]}}
                    rows.append(getattr(step, part)())
        return reduce(DataFrame.unionByName, rows)

    def _add(self, name: str, was: dict[str, dict], now: dict[str, dict]) -> DataFrame:
        key, folders = self.WRITTEN[name], self._folders[name]
        path = f"{self.store}/{name}-added-{len(folders)}"
        self._delta(name, was, now).write.mode("overwrite").parquet(path)
        self.log.append(f"{name}+")
        folders.append(path)
        plain = self.spark.read.parquet(*folders)
        if not (table := self._buckets.get(name)):
            return plain
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self._hot(plain, key, plain.count(), n):
            del self._buckets[name]
            self._tables.remove(table)
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            return plain
        spec = self.spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
        (self.spark.read.parquet(path).repartition(int(spec["data_type"]), key).write.mode("append")
         .bucketBy(int(spec["data_type"]), key).sortBy(key).format("parquet").saveAsTable(table))
        return self.spark.table(table)

    def totals(self, name: str, key: str, *sums: str) -> DataFrame:
        """Per ``key`` of a written view its rows, ``n_rows``, and the sum of each column of ``sums``.

        The totals of each folder of the view are written once; after :meth:`update` only those of the
        added rows are.  Totals of a key from several folders are summed when they are read.
        """
        view = self.view(name)
        def total(df: DataFrame) -> DataFrame:
            return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in sums])
        if not self.store:
            return total(view)
        paths = []
        for n, folder in enumerate(self._folders[name]):
            at = (name, folder, key, sums)
            if at not in self._totals:
                path = f"{self.store}/totals/{name}-{key}-{'-'.join(sums)}-{n}"
                total(self.spark.read.parquet(folder)).write.mode("overwrite").parquet(path)
                self.log.append(f"totals of {name}" + "+" * (n > 0))
                self._totals[at] = path
            paths.append(self._totals[at])
        parts = self.spark.read.parquet(*paths)
        return parts.groupBy(key).agg(F.sum("n_rows").alias("n_rows"), *[F.sum(c).alias(c) for c in sums])

    def prepare(self, *names: str) -> None:
        """Write the named views at the same time, where they are not written yet."""
        with ThreadPoolExecutor(max_workers=max(1, len(names))) as pool:
            list(pool.map(self.view, names))

    def keep(self, name: str, df: DataFrame, key: str | None = None) -> DataFrame:
        """Write a dataset that several reports (or several parts of one) read to the store, in buckets of
        ``key`` if given, and read it back; without a store it stays a plan."""
        return self._put(f"datasets/{name}", df, key) if self.store else df

    def drop(self) -> None:
        """Delete the written views (frames built on them can no longer be read)."""
        self._views.clear()
        for kept in (self._folders, self._buckets, self._inputs, self._totals, self._reads, self._seen):
            kept.clear()
        self.__dict__.pop("_dataset_memo", None)
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")
        if self.store:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _t(self, name: str) -> DataFrame:
        if noting := self._noting.__dict__.get("sets"):
            noting[-1].add(name)
        whole = load(self.spark, self.sf_dir, name)
        if name not in self._only:
            return whole
        return self.spark.read.schema(whole.schema).parquet(*self._only[name]) if self._only[name] else whole.where("false")

    # ---------------------------------------------------------------- helpers on customer keys
    @staticmethod
    def _k() -> Column:
        return F.col("c_custkey")

    @classmethod
    def _is_child(cls) -> Column:
        k = cls._k()
        return (k >= 10) & ((k % 10) >= 1) & ((k % 10) <= 4)

    @classmethod
    def _group(cls) -> Column:
        """Notice group of a customer's assessment."""
        return F.floor(cls._k() / 15)

    def _literal(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # ---------------------------------------------------------------- property register
    def build_property(self) -> DataFrame:
        return self.properties()

    def properties(self) -> DataFrame:
        k = self._k()
        child = self._is_child()
        parent = F.when(child, k - k % 10)
        ptype = (F.when(k % 29 == 0, F.lit("STRCARSPC")).when(k % 31 == 0, F.lit("UTILITY"))
                 .otherwise(F.lit("RESIDENCE")))
        address = (F.when(k % 29 == 0, F.concat(F.lit("Car Space "), F.col("c_name")))
                   .when(k % 37 == 0, F.concat(F.lit("Storage "), F.col("c_name")))
                   .otherwise(F.col("c_name")))
        df = (self._t("customer").join(self._t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
              .select(
                  k.alias("property_key"),
                  (k + 1000000).alias("tpklpaprop"),
                  parent.alias("parent_property_key"),
                  (parent + 1000000).alias("parent_property_tpklpaprop"),
                  F.when(k % 13 == 0, "H").otherwise("C").alias("status"),
                  _pad10(ptype).alias("property_type"),
                  address.alias("formatted_address"),
                  F.col("c_name").alias("address"),
                  F.col("n_name").alias("suburb"),
                  F.concat(F.col("n_name"), F.lit(" Road")).alias("street"),
                  F.when(child, F.concat(F.lit("Building "), (k - k % 10).cast("string")))
                  .alias("parent_property_address"),
                  F.concat(F.col("c_name"), F.lit("  ")).alias("formatted_owner_name"),
                  F.col("c_name").alias("owners_na_slab_1"),
                  F.col("c_mktsegment").alias("owners_na_slab_2"),
                  F.lit(None).cast("string").alias("owners_na_slab_3"),
                  F.lit(None).cast("string").alias("owners_na_slab_4"),
                  F.lit(None).cast("string").alias("owners_na_slab_5"),
                  (k + 500000).alias("assessment_key"),
                  (k + 700000).alias("assessment"),
              ))
        return normalise_codes(df, ["property_type"]) if self.normalise else df

    def build_reg_bserv_bin_services(self) -> DataFrame:
        """Bin service registration: one row per property whose account is not in debit, except
        household-segment shared-dwelling parents."""
        k = self._k()
        method = (F.when(k % 10 == 0, F.lit("SHA1")).when(self._is_child(), F.lit("MAN1"))
                  .otherwise(F.lit("SNG1")))
        household_parent = ((k % 10) == 0) & (F.col("c_mktsegment") == "HOUSEHOLD")
        return (self._t("customer").where((F.col("c_acctbal") >= 0) & ~household_parent)
                .select(k.alias("property_key_link_to_property"),
                        method.alias("c_calculation_method"),
                        F.lit(AUDIT_DATE).cast("timestamp_ntz").alias("c_audit_date")))

    def build_reg_bband_bin_bands(self) -> DataFrame:
        return self._literal(BIN_BANDS, "c_code string, c_minimum_value int, c_maximum_value int, "
                                        "c_calculation_method string")

    def build_property_service_codes_custom(self) -> DataFrame:
        return self._literal(SERVICE_CODES, "service_code string, is_active string")

    def build_property_services_facts(self) -> DataFrame:
        """Base service per property (not for households nor unit kinds 2/4), plus one service
        record per order line: current for open bulk lines (quantity >= 49), else removed when the
        line shipped (by ``LAST_END`` at the latest, but for lines of 48)."""
        return self.base_services().unionByName(self.line_services())

    def base_services(self) -> DataFrame:
        k = self._k()
        child = self._is_child()
        return (self._t("customer")
                .where((F.col("c_mktsegment") != "HOUSEHOLD") & ~(child & (k % 10).isin(2, 4)))
                .select(
                    k.alias("property_key"),
                    (k + 1000000).alias("tpklpaprop"),
                    F.when(child, "N0000UA").when(k % 12 == 0, "G0120").otherwise("R0001")
                    .alias("service_code"),
                    _pick(k % 3, ["80", "120", "240"]).alias("container_type"),
                    (1 + k % 2).cast("int").alias("number_of_collections"),
                    F.lit(1).alias("number_of_services"),
                    F.when(k % 17 == 0, "H").otherwise("C").alias("status"),
                    F.lit(None).cast("timestamp_ntz").alias("removal_date"),
                ))

    def line_services(self) -> DataFrame:
        ended = F.lit(LAST_END).cast("timestamp_ntz")
        current = (F.col("l_linestatus") == "O") & (F.col("l_quantity") >= 49)
        return (self._t("lineitem")
                .join(self._t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                 .select(
                     F.col("o_custkey").alias("property_key"),
                     (F.col("o_custkey") + 1000000).alias("tpklpaprop"),
                     F.when(F.col("l_returnflag") == "R", "R0002")
                     .when(F.col("l_returnflag") == "A", "G0120")
                     .when(F.col("l_returnflag") == "N", "N0120").alias("service_code"),
                     _pick(F.col("l_partkey") % 4, ["80", "120", "240", "BULK"]).alias("container_type"),
                     (1 + F.col("l_partkey") % 2).cast("int").alias("number_of_collections"),
                     (F.col("l_quantity").cast("int") % 3).alias("number_of_services"),
                     F.when(current, "C").otherwise("H").alias("status"),
                     F.when(~current, F.when(F.col("l_quantity") == 48, F.col("l_shipdate"))
                            .otherwise(F.least("l_shipdate", ended))).alias("removal_date"),
                 ))

    # ---------------------------------------------------------------- rates
    def build_rate_type(self) -> DataFrame:
        df = self._literal([(key, f"{code:<10}", cur, cat) for key, code, cur, cat in RATE_TYPES],
                           "ratetype_key bigint, ratetype string, is_current_period string, "
                           "category_code string")
        return normalise_codes(df, ["ratetype"]) if self.normalise else df

    def build_rate_type_facts(self) -> DataFrame:
        """Base rate per property (not automobile accounts, not shared-dwelling parents), plus one
        rate per order: open-ended for urgent orders that are not finished, else suspended at the
        order date (by ``LAST_END`` at the latest); of another category for household-segment shared-dwelling parents."""
        return self.base_rates().unionByName(self.order_rates())

    def base_rates(self) -> DataFrame:
        k = self._k()
        child = self._is_child()
        cls = F.when(((k % 10) >= 5) | (k < 10), 0).otherwise(6)
        binx = 2 * (F.when(child & (k % 10).isin(1, 2), 0).when(k % 8 == 0, (k + 1) % 3)
                    .otherwise(k % 3))
        freq = F.when(child, 0).when(k % 9 == 0, 0).otherwise(k % 2)
        return (self._t("customer")
                .where(((k % 10) != 0) & (F.col("c_mktsegment") != "AUTOMOBILE"))
                .select(
                    k.alias("property_key"),
                    k.alias("rate_type_key"),
                    F.when(k % 14 == 5, 2).otherwise(1).alias("units"),
                    (cls + binx + freq).cast("bigint").alias("ratetype_key"),
                    (k + 500000).alias("assessment_key"),
                    F.lit(None).cast("timestamp_ntz").alias("suspended_date"),
                ))

    def order_rates(self) -> DataFrame:
        household = self._t("customer").where(F.col("c_mktsegment") == "HOUSEHOLD").select(
            F.col("c_custkey").alias("__household_key"))
        ended = F.lit(LAST_END).cast("timestamp_ntz")
        open_ended = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F")
        general = F.col("__household_key").isNotNull() & ((F.col("o_custkey") % 10) == 0)
        return (self._t("orders")
                  .join(household, F.col("o_custkey") == F.col("__household_key"), "left")
                  .select(
                      F.col("o_custkey").alias("property_key"),
                      (-1 - F.col("o_orderkey")).alias("rate_type_key"),
                      F.lit(1).alias("units"),
                      F.when(general, 14).otherwise(4 + F.col("o_orderkey") % 11).alias("ratetype_key"),
                      (F.col("o_custkey") + 500000).alias("assessment_key"),
                      F.when(~open_ended, F.least("o_orderdate", ended)).alias("suspended_date"),
                  ))

    def build_rate_assessment(self) -> DataFrame:
        k = self._k()
        return self._t("customer").select(
            (k + 500000).alias("assessment_key"),
            (k + 700000).alias("assessment"),
            k.cast("string").alias("vgnumber"),
            (k + 1000000).alias("tfklpaprop"),
            F.col("c_name").alias("ratepayer_address_1"),
            F.when(k % 2 == 0, F.col("c_mktsegment")).alias("ratepayer_address_2"),
            F.when(k % 5 == 0, F.lit("PO Box")).alias("ratepayer_address_3"),
            F.lit(None).cast("string").alias("ratepayer_address_4"),
            F.lit(None).cast("string").alias("ratepayer_address_5"),
        )

    # ---------------------------------------------------------------- contacts
    def build_property_assessment_links(self) -> DataFrame:
        k = self._k()
        return self._t("customer").select((k + 1000000).alias("tfklpaprop"),
                                          (k + 500000).alias("assessment_key"))

    def build_property_owners(self) -> DataFrame:
        """One owner row per property, two for keys divisible by 6 (joint owners)."""
        k = self._k()
        seq = F.when(k % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return self._t("customer").select(k.alias("property_key"), F.explode(seq).alias("owner_seq"))

    def build_names_applications(self) -> DataFrame:
        k = self._k()
        return self._t("customer").select(
            (k + 500000).alias("tfkappl"),
            F.lit("LRA").alias("application"),
            F.when(k % 9 == 0, "Agent").otherwise("Ratepayer").alias("role_description"),
            k.alias("name_key"),
        )

    def build_names(self) -> DataFrame:
        k = self._k()
        return self._t("customer").select(
            k.alias("name_key"), F.concat(k.cast("string"), F.lit("@example.org")).alias("email"))

    # ---------------------------------------------------------------- CRM
    def build_onecrm_request_questions(self) -> DataFrame:
        """Two question rows per event: the property asked about and the case status.  Click and view
        events ask about bins, the others about something else."""
        e = F.col("event_id")
        qa = F.array(
            F.struct(F.lit("PropertyKey").alias("question"),
                     (F.col("user_id") + 1000000).cast("string").alias("answer")),
            F.struct(F.lit("CaseStatus").alias("question"),
                     _pick(e % 3, CASE_STATUSES).alias("answer")),
        )
        about = F.when(F.col("event_type").isin("click", "view"), _pick(e % 5, QUESTIONNAIRES))
        return self._t("events").select(e.alias("request_facts_key"),
                                        about.otherwise("Other").alias("questionnaire"), F.inline(qa))

    def build_onecrm_task_information(self) -> DataFrame:
        e = F.col("event_id")
        open_ = (F.col("event_type") == "purchase") & (e % 3 != 0)
        return (self._t("events")
                .select((F.col("user_id") + 1000000).alias("propertykey"),
                        F.when(open_, "In Progress").otherwise("Closed").alias("taskstatus"),
                        F.when(e % 2 == 0, "DW Charge Impact").otherwise("DW Charge Impact possible")
                        .alias("tasktype")))

    # ---------------------------------------------------------------- finance register
    @staticmethod
    def _agent_id() -> Column:
        return -1 - F.col("s_suppkey")

    def build_crgntry(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self._t("supplier").select(
            s.alias("tpkcrgntry"),
            F.when(s % 2 == 0, 84).otherwise(85).alias("tfkcrgregs"),
            F.col("s_name").alias("keyval"))

    def build_crgregv(self) -> DataFrame:
        """Two register values per entry: field 953 (notice group code), 954 (agent link)."""
        s = F.col("s_suppkey")
        rows = F.array(
            F.struct((2 * s).alias("tpkcrgregv"), F.lit(953).alias("tfkcrgfeld"),
                     F.concat(F.lit("NG"), s.cast("string")).alias("regfldvalu")),
            F.struct((2 * s + 1).alias("tpkcrgregv"), F.lit(954).alias("tfkcrgfeld"),
                     F.lit(None).cast("string").alias("regfldvalu")),
        )
        return (self._t("supplier").select(s.alias("tfkcrgntry"), F.inline(rows))
                .select("tpkcrgregv", "tfkcrgntry", "tfkcrgfeld", "regfldvalu"))

    def build_crgrole(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self._t("supplier").select(
            (2 * s + 1).alias("tfklocl"), F.lit("cna").alias("fkcrgrolta"),
            F.lit(1).alias("fkcrgroltn"), F.lit("c").alias("status"),
            self._agent_id().alias("tfkappl"))

    def build_cnaidty(self) -> DataFrame:
        agents = self._t("supplier").select(self._agent_id().alias("tpkcnaidty"),
                                            F.col("s_name").alias("formatname"))
        people = self._t("customer").select(self._k().alias("tpkcnaidty"),
                                            F.col("c_name").alias("formatname"))
        return agents.unionByName(people)

    def build_cnaaddr(self) -> DataFrame:
        """Agent addresses ('Level 1 <supplier>', some with characters that LIKE reads as a pattern);
        per customer an old address (2k) and a current one (2k+1) which, for k % 3 = 0, is care of
        the agent of its notice group."""
        return self.agent_addresses().unionByName(self.customer_addresses())

    def agent_addresses(self) -> DataFrame:
        s = F.col("s_suppkey")
        level = (F.when(s % 7 == 3, "Level _ ").when(s % 7 == 4, "Level [0-3] ").when(s % 7 == 5, "L%1 ")
                 .when(s % 7 == 6, "Level [^1] ").otherwise("LEVEL 1 "))
        return self._t("supplier").select(
            self._agent_id().alias("tpkcnaaddr"), F.concat(level, F.col("s_name")).alias("formataddr"))

    def customer_addresses(self) -> DataFrame:
        k = self._k()
        sup = self._t("supplier").select(F.col("s_suppkey").alias("agent_no"),
                                         F.col("s_name").alias("agent_name"))
        cust = self._t("customer").withColumn("agent_no", self._group()).join(sup, "agent_no", "left")
        rows = F.array(
            F.struct((2 * k).alias("tpkcnaaddr"),
                     F.concat(F.lit("old "), F.col("c_name")).alias("formataddr")),
            F.struct((2 * k + 1).alias("tpkcnaaddr"),
                     F.when(k % 3 == 0, F.concat(F.lit("c/o Level 1 "), F.col("agent_name")))
                     .otherwise(F.col("c_name")).alias("formataddr")),
        )
        return cust.select(F.inline(rows))

    def build_cnaidta(self) -> DataFrame:
        k = self._k()
        d95 = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
        d97 = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
        agents = self._t("supplier").select(
            self._agent_id().alias("tfkcnaidty"), self._agent_id().alias("tfkcnaaddr"),
            d95.alias("dateeffect"))
        rows = F.array(
            F.struct((2 * k).alias("tfkcnaaddr"),
                     F.when(k % 11 == 0, d97).otherwise(d95).alias("dateeffect")),
            F.struct((2 * k + 1).alias("tfkcnaaddr"), d97.alias("dateeffect")),
        )
        people = self._t("customer").select(k.alias("tfkcnaidty"), F.inline(rows))
        return agents.unionByName(people)

    def build_lrantgp(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self._t("supplier").select(s.alias("tpklrantgp"),
                                          F.concat(F.lit("NG"), s.cast("string")).alias("ntgpcode"))

    def build_lraassm(self) -> DataFrame:
        k = self._k()
        return self._t("customer").select(
            k.alias("tpklraassm"), self._group().alias("tfklrantgp"), k.cast("string").alias("assmnumber"),
            F.when(k % 13 == 0, "h").otherwise("c").alias("status"))

    def build_cnarole(self) -> DataFrame:
        k = self._k()
        return self._t("customer").select(
            k.alias("tpkcnarole"), k.alias("tfkappl"), F.lit("lra").alias("fkcnarolta"),
            F.lit(0).alias("fkcnaroltn"), F.lit("c").alias("status"), k.alias("tfkcnaidty"))

    def build_cnarola(self) -> DataFrame:
        """Override address role per ratepayer role; active only for keys divisible by 8."""
        k = self._k()
        return self._t("customer").select(
            k.alias("tfkcnarole"), (2 * k).alias("tfkcnaaddr"),
            F.when(k % 8 == 0, 1).otherwise(0).alias("isactive"),
            F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("dateeffect"))


VIEW_NAMES = ['property', 'reg_bserv_bin_services', 'reg_bband_bin_bands', 'property_service_codes_custom', 'property_services_facts', 'rate_type', 'rate_type_facts', 'rate_assessment', 'property_assessment_links', 'property_owners', 'names_applications', 'names', 'onecrm_request_questions', 'onecrm_task_information', 'crgntry', 'crgregv', 'crgrole', 'cnaidty', 'cnaaddr', 'cnaidta', 'lrantgp', 'lraassm', 'cnarole', 'cnarola']


def _view_property(name: str):
    return property(lambda self: self.view(name), doc=f"The ``{name}`` view.")


for _name in VIEW_NAMES:
    setattr(Domain, _name, _view_property(_name))

_DOMAINS: dict[tuple, Domain] = {}
_DOMAINS_LOCK = threading.Lock()


def domain(spark: SparkSession, sf_dir: str, normalise: bool = True,
           materialise: bool = True) -> Domain:
    """Session-wide register views over one folder of driver tables.

    With ``materialise`` (default) each derived view is written on its first use, once per session,
    to a folder of its input under the cluster's shared ``spark.checkpoint.dir``.  The views stay
    as they are until ``refresh`` is called.
    """
    from tallyframe.session import app_id, checkpoint_dir
    app, source = app_id(spark), _full(sf_dir)
    key = (app, source, normalise, materialise)
    with _DOMAINS_LOCK:
        if key not in _DOMAINS:
            store = None
            if materialise:
                tag = hashlib.sha256(source.encode()).hexdigest()[:24] + ("" if normalise else "-raw")
                store = f"{checkpoint_dir(spark)}/tallyframe-domain/{app}/{tag}"
            _DOMAINS[key] = Domain(spark, sf_dir, normalise, store)
        return _DOMAINS[key]


def _full(source: str) -> str:
    """The whole path of a folder; a URI stays as it is."""
    return source.rstrip("/") if ":/" in source else os.path.abspath(source)


def refresh(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Forget what the session keeps of ``sf_dir`` (of every folder without it): file lists, register
    views and their written tables, dataset plans.  Later queries read the folder anew."""
    from tallyframe.session import app_id
    app = app_id(spark)
    with _DOMAINS_LOCK:
        for key in [k for k in _DOMAINS if k[0] == app and (sf_dir is None or k[1] == _full(sf_dir))]:
            _DOMAINS.pop(key).drop()
    forget(spark, sf_dir)


def update(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Bring what the session keeps of ``sf_dir`` up to date with its files, deriving as little again as
    :meth:`Domain.update` allows; returns what was done with each written view."""
    from tallyframe.session import app_id
    app, done = app_id(spark), {}
    with _DOMAINS_LOCK:
        for key in [k for k in _DOMAINS if k[:2] == (app, _full(sf_dir))]:
            did = _DOMAINS[key].update()
            done |= did if key[2] else {f"{name} (raw)": what for name, what in did.items()}
    forget(spark, sf_dir)
    return done


__all__ = ["Domain", "domain", "BIN_BANDS", "SERVICE_CODES", "RATE_TYPES", "VIEW_NAMES", "refresh", "update"]
