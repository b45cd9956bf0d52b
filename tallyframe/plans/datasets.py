"""Shared datasets of the reconciliation reports.

Each function takes a ``Domain`` (the register tables) and an explicit ``as_of`` instant and
returns a lazy DataFrame; reports compose them and Catalyst plans the whole DAG at once, so a
dataset used by several reports is not a materialisation barrier.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import dec_avg, int_avg, int_div, try_int
from tallyframe.functions.predicates import (active_any, instant, m_eq, m_filter, m_ne, not_ended,
                                             starts)
from tallyframe.functions.text import concat_lines, decode_rate_type
from tallyframe.operators.aggregates import count_over
from tallyframe.operators.joins import (band_lookup, branch_parents, eav_count, join_text_key,
                                        latest_effective, leaf_parents, left_join_skew_safe,
                                        nested_join)
from tallyframe.sources.domain import Domain

def _memo(fn, keep: bool = False, by: str | None = None):
    """Memoise a dataset per (register views, arguments): DataFrames are immutable plans, so a
    dataset used by several reports (or several times in one report) is built once, and Spark sees
    identical subtrees whose shuffles it can reuse.  ``tallyframe.refresh`` forgets it."""
    def wrapper(d: Domain, *args, **kwargs):
        cache = d.__dict__.setdefault("_dataset_memo", {})
        key = (fn.__module__, fn.__name__, *[str(a) for a in args],
               *[f"{k}={v}" for k, v in sorted(kwargs.items())])

        def make() -> DataFrame:
            df = fn(d, *args, **kwargs)
            return d.keep(f"{fn.__name__}-{hashlib.sha256(repr(key).encode()).hexdigest()[:12]}", df, by) if keep else df
        return d.noted(cache, key, make, keep)
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    wrapper.__wrapped__ = fn
    return wrapper


def _kept_by(key: str):
    """As :func:`_kept`, in buckets of the column that reports join and aggregate on."""
    return lambda fn: _memo(fn, keep=True, by=key)


def _kept(fn):
    """Memoise, and write the dataset to the domain's store on first use: for datasets that a report
    reads more than once (per-key totals, skew-safe joins) or that several reports share.  Their joins
    then run once, a lost executor reads the written table again, and plans stay small."""
    return _memo(fn, keep=True)


# CRM filters.
BIN_QUESTIONNAIRES = ["New bin", "Remove bin", "Repair or replace bin", "Upsize or downsize bin"]
OPEN_CASE_STATUSES = ["Submitted", "Under Review", "No Review Required", "Approved"]
TASK_RATES_IMPACT = "DW Charge Impact"
TASK_CW_IMPACT = "DW Charge Impact possible"


# ============================================================================ rates
@_kept_by("property_key")
def current_rate_facts(d: Domain, as_of) -> DataFrame:
    """Rate facts not suspended at ``as_of``.  Kept, since rates, their counts and pairs read them several
    times: few of all facts are current, so the others are neither joined, shuffled nor written."""
    return d.derived("rate_type_facts").where(not_ended("suspended_date", as_of))


def current_rates(d: Domain, as_of, category: str = "DWM", with_assessment: bool = True,
                  exclude_special: bool = False) -> DataFrame:
    """Rate facts of current-period rate types of one category, not suspended at ``as_of``,
    with the decoded bin type and frequency (and the rate assessment)."""
    rt = d.rate_type.where((F.col("is_current_period") == "Y") & (F.col("category_code") == category))
    if exclude_special:
        rt = rt.where(F.col("ratetype") != "N0000UA")
    rates = decode_rate_type(current_rate_facts(d, as_of).join(rt, "ratetype_key"))
    if with_assessment:
        rates = rates.join(d.rate_assessment, "assessment_key")
    return rates


@_memo
def rates_with_counts(d: Domain, as_of) -> DataFrame:
    """Single-dwelling rate side: one row per current rate with its property's rate count."""
    r = current_rates(d, as_of).select(
        F.col("property_key").alias("rate_property_key"), "rate_type_key",
        F.col("units").alias("rate_units"), "ratetype_key", "ratetype", "rate_bin_type",
        "rate_frequency", "assessment", "vgnumber")
    return count_over(r, "ratetype", ["rate_property_key"], "number_rate_records", null_safe=False)


# ============================================================================ services
@_memo
def current_services(d: Domain, as_of) -> DataFrame:
    """Service facts that are active at ``as_of`` and of a bin stream: red (R), inactive-code
    green (G with an inactive code), or N; with the code's ``is_active``."""
    codes = d.property_service_codes_custom
    psf = d.derived("property_services_facts").where(
        active_any("status", "removal_date", as_of)
        & (starts("service_code", "R") | starts("service_code", "G") | starts("service_code", "N")))
    j = psf.join(codes, "service_code", "left")
    return j.where(starts("service_code", "R")
                   | (starts("service_code", "G") & (F.col("is_active") == "No"))
                   | starts("service_code", "N"))


@_kept_by("property_key")
def active_red_services(d: Domain, as_of) -> DataFrame:
    """Red service facts that are active at ``as_of``.  Kept, since the band lookup and the counts read them
    several times: few of all facts are, and only their lines meet the orders."""
    return d.derived("property_services_facts").where(
        active_any("status", "removal_date", as_of) & starts("service_code", "R"))


def single_service_groups(d: Domain, as_of, method_prefix: str = "SNG") -> DataFrame:
    """Active red services of single-dwelling registrations, classified into bin bands by
    container size and grouped per property, band, method and collection frequency."""
    pbr = d.reg_bserv_bin_services
    svc = (active_red_services(d, as_of)
           .join(pbr, F.col("property_key") == F.col("property_key_link_to_property"))
           .where(starts("c_calculation_method", method_prefix))
           .withColumn("bin_size", try_int("container_type", blank_as_zero=True)))
    svc = band_lookup(svc, d.reg_bband_bin_bands, "bin_size", "bin_type",
                      by=("c_calculation_method", "c_calculation_method"))
    return (svc.groupBy("property_key", "tpklpaprop", "bin_type", "c_calculation_method",
                        "number_of_collections")
            .agg(F.sum("number_of_services").alias("service_units"),
                 int_avg("bin_size").alias("avg_bin_size")))


def single_property_services(d: Domain, as_of, with_assessment_key: bool = True) -> DataFrame:
    """Current properties with their single-dwelling service groups and service-group count."""
    out = _single_property_services(d, as_of)
    return out if with_assessment_key else out.drop("assessment_key")


@_memo
def _single_property_services(d: Domain, as_of) -> DataFrame:
    psg = single_service_groups(d, as_of).select(
        F.col("property_key").alias("__svc_key"), F.col("bin_type").alias("service_bin_type"),
        F.col("c_calculation_method").alias("__method"),
        F.col("number_of_collections").alias("service_frequency"), "service_units", "avg_bin_size")
    pbr = d.reg_bserv_bin_services.select(F.col("property_key_link_to_property").alias("__reg_key"),
                                          "c_audit_date")
    p = d.derived("property").where(F.col("status") == "C")
    cols = ["property_key", "tpklpaprop", "formatted_address", "suburb", "property_type", "assessment_key"]
    out = (p.join(psg, F.col("property_key") == F.col("__svc_key"))
           .join(pbr, F.col("property_key") == F.col("__reg_key"), "left")
           .select(*cols, "service_bin_type", "service_frequency", "service_units", "avg_bin_size",
                   F.left(F.col("__method"), F.lit(3)).alias("calculation_method"), "c_audit_date"))
    out = count_over(out, "service_bin_type", ["tpklpaprop"], "number_service_records",
                     null_safe=False)
    return out.select(*cols, "service_bin_type", "service_frequency", "service_units",
                      "avg_bin_size", "calculation_method", "number_service_records", "c_audit_date")


@_memo
def shared_parents(d: Domain, as_of) -> DataFrame:
    """Shared-dwelling parents: total container volume (size x collections x services) and the
    average collection frequency of their active red services."""
    pbr = d.reg_bserv_bin_services.where(starts("c_calculation_method", "SHA"))
    ps = active_red_services(d, as_of)
    p = d.property.where(F.col("status") == "C").select(
        F.col("property_key").alias("parent_key"), F.col("tpklpaprop").alias("parent_tpklpaprop"),
        F.col("formatted_address").alias("parent_formatted_address"),
        F.col("suburb").alias("parent_suburb"))
    j = (p.join(ps, F.col("parent_key") == F.col("property_key"))
         .join(pbr, F.col("parent_key") == F.col("property_key_link_to_property")))
    vol = (try_int("container_type", blank_as_zero=True) * F.col("number_of_collections")
           * F.col("number_of_services"))
    return (j.groupBy("parent_key", "parent_tpklpaprop", "parent_formatted_address", "parent_suburb")
            .agg(F.sum(vol).alias("total_volume"),
                 dec_avg("number_of_collections").alias("avg_frequency")))


@_kept_by("parent_property_key")
def shared_child_rates(d: Domain, as_of) -> DataFrame:
    """Child properties with their current DWM rates and the number of rated children per parent."""
    cp = d.property.select("parent_property_key", "property_key", "parent_property_tpklpaprop",
                           "tpklpaprop", F.col("formatted_address").alias("child_formatted_address"),
                           F.col("suburb").alias("child_suburb"))
    r = current_rates(d, as_of).select(F.col("property_key").alias("__rk"), "rate_type_key",
                                       F.col("units").alias("rate_units"), "ratetype_key",
                                       "ratetype", "rate_bin_type", "rate_frequency", "assessment",
                                       "vgnumber")
    j = cp.join(r, F.col("property_key") == F.col("__rk")).drop("__rk")
    j = count_over(j, "property_key", ["parent_property_key"], "eligible_properties",
                   null_safe=False)
    return j.select("parent_property_key", "property_key", "parent_property_tpklpaprop",
                    "tpklpaprop", "eligible_properties", "child_formatted_address", "child_suburb",
                    "rate_type_key", "rate_units", "ratetype_key", "ratetype", "rate_bin_type",
                    "rate_frequency", "assessment", "vgnumber")


@_memo
def shared_volume(d: Domain, as_of) -> DataFrame:
    """Parents x rated children with the per-child volume (integer division) and its band."""
    parents = shared_parents(d, as_of)
    rates = shared_child_rates(d, as_of)
    # one parent may hold a large share of all rated children
    j = left_join_skew_safe(parents, rates, "parent_key", "parent_property_key")
    j = j.withColumn("avg_bin_size", int_div("total_volume", "eligible_properties"))
    return band_lookup(j, d.reg_bband_bin_bands, "avg_bin_size", "service_bin_type",
                       band_filter=starts("c_calculation_method", "SHA"))


# ============================================================================ CRM
@_memo
def request_counts(d: Domain) -> DataFrame:
    """Open bin requests per property: each request row naming the property is paired with the
    open-status rows of the same request (attribute-value rows), counted per property key text."""
    orq = d.onecrm_request_questions
    return eav_count(orq, "request_facts_key", "answer",
                     anchor=(F.col("question") == "PropertyKey")
                     & F.col("questionnaire").isin(*BIN_QUESTIONNAIRES),
                     other=(F.col("question") == "CaseStatus") & F.col("answer").isin(*OPEN_CASE_STATUSES),
                     anchor_name="propertykey", count_name="number_bin_requests")


@_memo
def task_counts(d: Domain, task_type: str, name: str) -> DataFrame:
    """In-progress CRM tasks of one type per property."""
    oti = d.onecrm_task_information
    return (oti.where((F.col("taskstatus") == "In Progress") & (F.col("tasktype") == task_type))
            .groupBy("propertykey").agg(F.count("propertykey").alias(name)))


@_memo
def task_counts_by_type(d: Domain, **types: str) -> DataFrame:
    """In-progress CRM tasks per property, one column per type (null: none), from one pass over the tasks."""
    oti = d.onecrm_task_information
    open_ = oti.where((F.col("taskstatus") == "In Progress") & F.col("tasktype").isin(*types.values()))
    return open_.groupBy("propertykey").agg(*[
        F.nullif(F.count(F.when(F.col("tasktype") == t, F.col("propertykey"))), F.lit(0)).alias(name) for name, t in types.items()])


def attach_crm_counts(df: DataFrame, d: Domain, key: str) -> DataFrame:
    """Left-join the three CRM counts on a register id column ``key``."""
    req = request_counts(d).select(F.col("propertykey").alias("__req_key"), "number_bin_requests")
    tasks = task_counts_by_type(d, number_rates_impact=TASK_RATES_IMPACT, number_cw_impact=TASK_CW_IMPACT)
    tasks = tasks.withColumnRenamed("propertykey", "__task_key")
    out = join_text_key(df, req, "__req_key", key)
    out = out.join(tasks, F.col(key) == F.col("__task_key"), "left")
    return out.drop("__req_key", "__task_key")


# ============================================================================ contacts
@_memo
def ratepayer_contact(d: Domain) -> DataFrame:
    """Per (register id, assessment key): the ratepayer's address lines and e-mail.  Joined to a
    report with a left join; the multi-line address is assembled after that join, so a property
    without a link gets an empty address, not a null one."""
    pal = d.property_assessment_links.select(F.col("tfklpaprop").alias("c_tpk"),
                                             F.col("assessment_key").alias("c_asmt"))
    ra = d.rate_assessment.select(F.col("assessment_key").alias("c_ra_key"),
                                  *[F.col(f"ratepayer_address_{i}").alias(f"c_line_{i}")
                                    for i in range(1, 6)])
    na = d.names_applications.where((F.col("application") == "LRA")
                                    & (F.col("role_description") == "Ratepayer"))
    j = (pal.join(ra, F.col("c_asmt") == F.col("c_ra_key"), "left")
         .join(na, F.col("c_ra_key") == F.col("tfkappl"), "left")
         .join(d.names, "name_key", "left"))
    return j.select("c_tpk", "c_asmt", *[f"c_line_{i}" for i in range(1, 6)],
                    F.col("email").alias("ratepayer_email"))


def contact_columns() -> dict:
    return {"ratepayer_address": concat_lines(*[f"c_line_{i}" for i in range(1, 6)])}


# ============================================================================ family totals (M)
@_memo
def m_property(d: Domain) -> DataFrame:
    """M ``Property``: current properties other than car spaces and utilities, 17 columns."""
    p = d.property.where(m_filter(m_ne("property_type", "STRCARSPC") & m_ne("property_type", "UTILITY")
                                  & m_eq("status", "C")))
    return p.select("property_key", "formatted_address", "address", "suburb", "street", "status",
                    "tpklpaprop", "parent_property_key", "parent_property_address",
                    "formatted_owner_name", "owners_na_slab_1", "owners_na_slab_2",
                    "owners_na_slab_3", "owners_na_slab_4", "owners_na_slab_5", "assessment",
                    "assessment_key")


@_memo
def m_parent_properties(d: Domain) -> DataFrame:
    return m_property(d).where(F.col("parent_property_key").isNull())


@_memo
def m_child_properties(d: Domain) -> DataFrame:
    return m_property(d).where(F.col("parent_property_key").isNotNull())


@_kept_by("property_key")
def m_services_facts(d: Domain) -> DataFrame:
    """M ``Property_Services_Facts``: only status C rows.  Kept, since the family totals read them several times."""
    return d.derived("property_services_facts").where(m_filter(m_eq("status", "C")))


@_memo
def m_current_rate_types(d: Domain) -> DataFrame:
    rt = d.rate_type.where(m_filter(m_eq("is_current_period", "Y") & m_eq("category_code", "DWM")))
    return rt.withColumns({"rate_bin_type": F.substring("ratetype", 4, 3),
                           "rate_frequency": F.right(F.col("ratetype"), F.lit(2))})


def m_stream_filter(code: str, is_active: str) -> Column:
    c = F.left(F.col(code), F.lit(1))
    return m_eq(c, "R") | (m_eq(c, "G") & m_eq(is_active, "No")) | m_eq(c, "N")


def m_active_services(d: Domain, as_of, exclude_special: bool = False) -> DataFrame:
    """Active bin-stream services with their code's ``is_active`` (M two-valued logic)."""
    c = F.left(F.col("service_code"), F.lit(1))
    psf = m_services_facts(d).where(m_filter(
        (m_eq("status", "C") | (F.col("removal_date") > instant(as_of)))
        & (m_eq(c, "R") | m_eq(c, "G") | m_eq(c, "N"))))
    j = nested_join(psf, d.property_service_codes_custom, ["service_code"], ["service_code"],
                    {"is_active": "is_active"}, null_keys=False)
    j = j.where(m_filter(m_stream_filter("service_code", "is_active")))
    if exclude_special:
        j = j.where(m_filter(m_ne("service_code", "N0000UA")))
    return j


def m_service_summary(d: Domain, as_of, exclude_special: bool, labels: dict) -> DataFrame:
    """Per property: services, red services, category (``PropertyServices`` / ``SUDServices``)."""
    j = m_active_services(d, as_of, exclude_special)
    red = F.when(m_filter(m_eq(F.left(F.col("service_code"), F.lit(1)), "R")),
                 F.col("number_of_services")).otherwise(0)
    g = j.groupBy("property_key").agg(F.sum("number_of_services").alias("number_of_services"),
                                      F.sum(red).alias("number_of_red_services"),
                                      F.min("is_active").alias("__active"))
    cat = (F.when(F.col("__active").isNull(), labels["missing"])
           .when(m_filter(m_eq("number_of_services", 0)), labels["zero"])
           .when(m_filter(m_eq("__active", "Yes")), labels["has"])
           .when(m_filter(m_eq("__active", "No")), "Old Service Code")
           .otherwise("Unknown"))
    return g.withColumn("service_category", cat).drop("__active")


@_memo
def m_property_services(d: Domain, as_of) -> DataFrame:
    return m_service_summary(d, as_of, False, {"missing": "Missing service", "zero": "Zero service",  # fixed values
                                               "has": "Has service"})


@_memo
def m_sud_services(d: Domain, as_of) -> DataFrame:
    return m_service_summary(d, as_of, True, {"missing": "Missing Service", "zero": "Zero Service",
                                              "has": "Has Service"})


@_memo
def m_bin_services_info(d: Domain) -> DataFrame:
    r = d.reg_bserv_bin_services
    return r.select(F.col("property_key_link_to_property").alias("property_key"),
                    F.when(F.col("c_calculation_method").isNull(), F.lit("None"))
                    .otherwise(F.left(F.col("c_calculation_method"), F.lit(4)))
                    .alias("calculation_method"))


@_memo
def m_property_rates(d: Domain, as_of) -> DataFrame:
    """Per property: number of current DWM rates and their unit total (``PropertyRates``)."""
    rtf = current_rate_facts(d, as_of)
    j = nested_join(rtf, m_current_rate_types(d), ["ratetype_key"], ["ratetype_key"],
                    ["is_current_period", "category_code"], how="inner", null_keys=False)
    j = j.where(m_filter(m_eq("is_current_period", "Y") & m_eq("category_code", "DWM")
                         & (F.col("suspended_date").isNull()
                            | (F.col("suspended_date") > instant(as_of)))))
    return j.groupBy("property_key").agg(F.count(F.lit(1)).alias("number_of_rates"),
                                         F.sum("units").alias("rate_units"))


@_memo
def m_child_rates_totals(d: Domain, as_of) -> DataFrame:
    """Per parent: children's current rate units and rates (nulls as 0) and child count."""
    cp = m_child_properties(d)
    j = nested_join(cp, m_property_rates(d, as_of), ["property_key"], ["property_key"],
                    ["rate_units", "number_of_rates"], null_keys=False)
    j = j.fillna(0, subset=["rate_units", "number_of_rates"])
    g = j.groupBy("parent_property_key").agg(F.sum("rate_units").alias("total_child_rate_units"),
                                             F.sum("number_of_rates").alias("total_child_rates"),
                                             F.count(F.lit(1)).alias("total_child_props"))
    return g.withColumnRenamed("parent_property_key", "property_key")


@_kept_by("property_key")
def m_rates_with_assessment(d: Domain, as_of) -> DataFrame:
    """Current DWM rates other than N0000UA with their assessment, shared by the three audits."""
    rtf = current_rate_facts(d, as_of)
    j = nested_join(rtf, m_current_rate_types(d), ["ratetype_key"], ["ratetype_key"],
                    ["is_current_period", "category_code", "ratetype"], how="inner", null_keys=False)
    j = j.where(m_filter(m_eq("is_current_period", "Y") & m_eq("category_code", "DWM")
                         & m_ne("ratetype", "N0000UA")
                         & (F.col("suspended_date").isNull()
                            | (F.col("suspended_date") > instant(as_of)))))
    return nested_join(j, d.rate_assessment, ["assessment_key"], ["assessment_key"],
                       {"assessment": "assessment", "vgnumber": "vgnumber",
                        "ratepayer_address_1": "ratepayer"}, how="inner", null_keys=False)


@_memo
def m_sud_rates(d: Domain, as_of) -> DataFrame:
    return m_rates_with_assessment(d, as_of).select(
        "property_key", "ratetype", "assessment", "vgnumber", "ratepayer")


@_kept_by("parent_property_key")
def m_child_rates(d: Domain, as_of) -> DataFrame:
    j = m_rates_with_assessment(d, as_of)
    j = nested_join(j, m_child_properties(d), ["property_key"], ["property_key"],
                    {"parent_property_key": "parent_property_key", "tpklpaprop": "child_tpklpaprop",
                     "formatted_address": "child_formatted_address", "suburb": "child_suburb"},
                    how="inner", null_keys=False)
    return j.select("property_key", "parent_property_key", "child_tpklpaprop",
                    "child_formatted_address", "child_suburb", "ratetype", "assessment", "vgnumber",
                    "ratepayer")


@_memo
def m_sud_properties(d: Domain) -> DataFrame:
    """Parents without children (single dwellings)."""
    # the parents themselves are rows with a null parent key, which M matches to a null key: a parent
    # without a key is never childless, and rows without a parent need not be looked at
    keyed = m_parent_properties(d).where(F.col("property_key").isNotNull())
    return leaf_parents(keyed, m_property(d))


@_kept_by("property_key")
def m_mud_parent_properties(d: Domain) -> DataFrame:
    """Distinct parents that have children (multi dwellings)."""
    return branch_parents(m_parent_properties(d), m_child_properties(d),
                          cols=["property_key", "tpklpaprop", "formatted_address", "suburb", "status"])


@_memo
def m_parent_rates(d: Domain, as_of) -> DataFrame:
    j = m_rates_with_assessment(d, as_of)
    j = nested_join(j, m_mud_parent_properties(d), ["property_key"], ["property_key"], [],
                    how="left_semi", null_keys=False)
    return j.select("property_key", "ratetype", "assessment", "vgnumber", "ratepayer")


def _side_summary(owners: DataFrame, key: str, services: DataFrame, as_of, prefix: str) -> DataFrame:
    """Per owner key: the service rows that survive the parent/child stream filter, summarised so
    that the parent x child product can be formed from counts instead of rows.

    An owner without service rows keeps one null row (count 1, zero sums), as a left join does;
    an owner whose rows all fail the filter disappears.  Services are summed per property before the
    join, so an owner with very many of them is one row there.
    """
    code, n = F.col(f"{prefix}_service_code"), F.col(f"{prefix}_number_of_services")
    act = F.col(f"{prefix}_is_active")
    ok = code.isNull() | (
        ((F.col(f"{prefix}_status") == "C") | (F.col(f"{prefix}_removal_date")
                                               > instant(as_of)))
        & (m_eq(F.left(code, F.lit(1)), "R") | (m_eq(F.left(code, F.lit(1)), "G") & m_eq(act, "No"))
           | m_eq(F.left(code, F.lit(1)), "N")))
    notnull = code.isNotNull()
    sums = {"count": F.when(notnull & m_ne(code, "N0000UA"), n).otherwise(0),
            "red": F.when(notnull & m_eq(F.left(code, F.lit(1)), "R"), n).otherwise(0),
            "any": F.when(notnull, n).otherwise(0),
            "ua": F.when(m_filter(m_eq(code, "N0000UA") & m_eq(act, "Yes")), 1).otherwise(0)}
    ok = m_filter(ok)
    per_key = services.where(F.col("property_key").isNotNull()).groupBy(F.col("property_key").alias("__owner")).agg(
        F.count(F.when(ok, 1)).alias(f"{prefix}_rows"), F.min(F.when(ok, act)).alias(f"{prefix}_min_active"),
        *[F.sum(F.when(ok, x)).alias(f"{prefix}_{name}") for name, x in sums.items()])
    none = F.col("__owner").isNull()
    return (owners.join(per_key, F.col(key) == F.col("__owner"), "left").where(none | (F.col(f"{prefix}_rows") > 0))
            .groupBy(key).agg(F.sum(F.when(none, 1).otherwise(F.col(f"{prefix}_rows"))).alias(f"{prefix}_rows"),
                              *[F.sum(F.when(none, 0).otherwise(F.col(f"{prefix}_{name}"))).alias(f"{prefix}_{name}") for name in sums],
                              F.min(f"{prefix}_min_active").alias(f"{prefix}_min_active")))


@_kept
def m_parent_child_service_aggregation(d: Domain, as_of) -> DataFrame:
    """Per multi-dwelling parent: parent and child service totals over the parent x child service
    combinations, the category and the N0000UA flag (``ParentChildServiceAggregation``).

    The source joins parent services and child services at once, so sums count every combination.
    The same numbers come from per-side summaries: over children c with r_p parent rows and r_c
    child rows, sum(parent x) = sum_c r_c * S_p, sum(child y) = sum_c r_p * S_c, and the rows with
    an N0000UA on either side number r_p r_c - (r_p - U_p)(r_c - U_c).  No row product is formed.
    """
    parents = m_mud_parent_properties(d)
    psf = m_services_facts(d)
    codes = d.property_service_codes_custom

    def side(owner_keys: DataFrame, key: str, prefix: str) -> DataFrame:
        columns = ["service_code", "number_of_services", "status", "removal_date"]
        services = psf.select("property_key", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
        services = nested_join(services, codes, [f"{prefix}_service_code"], ["service_code"],
                               {"is_active": f"{prefix}_is_active"}, null_keys=False)
        return _side_summary(owner_keys, key, services, as_of, prefix)

    p_side = side(parents.select("property_key"), "property_key", "parent")
    children = nested_join(parents.select("property_key"), m_child_properties(d), ["property_key"],
                           ["parent_property_key"], {"property_key": "child_property_key"}, null_keys=False)
    c_side = side(children.select("child_property_key").distinct(), "child_property_key", "child")
    c_side = c_side.withColumnRenamed("child_property_key", "__ck")
    combo = children.join(c_side, F.col("child_property_key").eqNullSafe(F.col("__ck"))).drop("__ck")
    rp, rc = F.col("parent_rows"), F.col("child_rows")
    per_child = combo.join(p_side, "property_key").select(
        "property_key",
        (rc * F.col("parent_count") + rp * F.col("child_count")).alias("t_services"),
        (rc * F.col("parent_red") + rp * F.col("child_red")).alias("t_red"),
        (rp * F.col("child_any")).alias("t_child_any"),
        (rc * F.col("parent_any")).alias("t_parent_any"),
        (rp * rc - (rp - F.col("parent_ua")) * (rc - F.col("child_ua"))).alias("t_ua"),
        F.col("parent_min_active"))
    g = per_child.groupBy("property_key").agg(
        F.sum("t_services").alias("total_number_of_services"),
        F.sum("t_red").alias("number_of_red_services"),
        F.sum("t_child_any").alias("__child_total"), F.sum("t_parent_any").alias("__parent_total"),
        F.sum("t_ua").alias("__ua"), F.min("parent_min_active").alias("__parent_active"))
    cat = (F.when(F.col("__child_total") > 0, "Child Has Service")
           .when(F.col("__parent_active").isNull(), "Missing Service")
           .when(F.col("__parent_total") == 0, "Zero Service")
           .when(F.col("__parent_active") == "Yes", "Has Service")
           .when(F.col("__parent_active") == "No", "Old Service Code")
           .otherwise("Unknown"))
    out = (g.join(parents, "property_key")
           .withColumns({"service_category": cat,
                         "has_n0000ua": F.when(F.col("__ua") > 0, "Yes").otherwise("No")}))
    return out.select("property_key", "tpklpaprop", "formatted_address", "suburb",
                      "total_number_of_services", "number_of_red_services", "service_category",
                      "has_n0000ua")


# ============================================================================ finance
@_memo
def m_assessment_info(d: Domain) -> DataFrame:
    """M ``AssessmentInfo``: the assessment number and valuation group of a register id."""
    return d.rate_assessment.select("tfklpaprop", "assessment", "vgnumber")


@_memo
def effective_address(d: Domain) -> DataFrame:
    """Latest address link(s) per identity (ties kept), with the address text."""
    links = latest_effective(d.cnaidta, ["tfkcnaidty"], "dateeffect")
    return links.join(d.cnaaddr, F.col("tfkcnaaddr") == F.col("tpkcnaaddr")).select(
        "tfkcnaidty", "tfkcnaaddr", "dateeffect", "formataddr")


@_memo
def active_override_address(d: Domain) -> DataFrame:
    """Latest active override address role(s) per ratepayer role."""
    active = d.cnarola.where(F.col("isactive") == 1)
    return latest_effective(active, ["tfkcnarole"], "dateeffect")


