"""The reconciliation reports (one function each; ``as_of`` replaces the wall clock).

J1 single dwellings, non-matches      J2 single dwellings, matches
J3 shared dwellings, non-matches      J4 shared dwellings, matches
J5 rates without services (SQL form)  J6 services without rates (SQL form)
J7 historic properties with services  J8 assessment mailing-address audit
J9 services without rates (M form)    J10 rates without services (M form)

J1-J7 come in the order of the source, ascending with nulls first; J8-J10 have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.predicates import (active_all, active_any, code_flag, filter_optional, m_eq,
                                             m_filter, m_ne, mismatch_flag, not_contains)
from tallyframe.functions.text import trim_end
from tallyframe.operators.aggregates import over_keys, service_category
from tallyframe.operators.joins import left_join_skew_safe, nested_join, no_current, with_children
from tallyframe.operators.reconcile import (add_flags, add_pair_counts, pair_by_key,
                                            reconcile_matches, reconcile_nonmatches)
from tallyframe.plans import datasets as ds
from tallyframe.sources.domain import Domain

SINGLE_FLAGS = ["bin_type_mismatch", "frequency_mismatch", "units_mismatch", "rate_type_mismatch"]
SHARED_FLAGS = ["bin_type_mismatch", "frequency_mismatch", "rate_type_mismatch"]


def sorted_report(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in ascending order of ``keys``, nulls first, and of all other columns after them.

    Spark samples bounds over the whole sort key.  With the ties in it, bounds fall inside a hot key too,
    so the rows of one property spread over as many tasks as their share of the data asks for.
    """
    ties = [c for c in df.columns if c not in keys]
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in [*keys, *ties]])


# ============================================================================ J1 / J2
@ds._kept_by("property_key")
def _service_rate_pairs(d: Domain, as_of) -> DataFrame:
    return pair_by_key(ds.single_property_services(d, as_of), ds.rates_with_counts(d, as_of),
                       "property_key", "rate_property_key")


@ds._memo
def _flagged_pairs(d: Domain, as_of) -> DataFrame:
    return _flags_and_counts(_service_rate_pairs(d, as_of))


def _flags_and_counts(df: DataFrame) -> DataFrame:
    df = add_flags(df,
                   compare={"bin_type_mismatch": ("service_bin_type", "rate_bin_type", "0"),
                            "frequency_mismatch": ("service_frequency", "rate_frequency", 0),
                            "units_mismatch": ("service_units", "rate_units", 0)},
                   codes={"rate_type_mismatch": ("ratetype", 3, "S")})
    # plain equi-join back keeps the key partitioning (a null key still forms one group)
    return add_pair_counts(df, ["tpklpaprop"], "service_bin_type", "rate_bin_type",
                           "number_bin_matched", "number_bin_mismatched", null_safe=False)


def _with_contacts(pairs: DataFrame, d: Domain) -> DataFrame:
    """One row per pair, owner and contact of the property."""
    contact = ds.ratepayer_contact(d)
    owners = d.property_owners.select(F.col("property_key").alias("__owner_key"))
    # owners join on the pairing key first (same partitioning), then the contact lookup; both are
    # left joins, so the order does not change the rows the pair counts see
    return (pairs.join(owners, F.col("property_key") == F.col("__owner_key"), "left")
            .join(contact, (F.col("tpklpaprop") == F.col("c_tpk"))
                  & (F.col("assessment_key") == F.col("c_asmt")), "left")
            .withColumns(ds.contact_columns())
            .drop("c_tpk", "c_asmt", "__owner_key", *[f"c_line_{i}" for i in range(1, 6)]))


@ds._kept_by("tpklpaprop")
def _contact_pairs(d: Domain, as_of) -> DataFrame:
    """Kept, since the pair counts read it twice: the owner and contact joins then run once."""
    return _with_contacts(_service_rate_pairs(d, as_of), d)


@ds._memo
def _single_pairs(d: Domain, as_of, contacts: bool, dedupe_owners: bool = False) -> DataFrame:
    if not contacts:
        return _flagged_pairs(d, as_of)
    if dedupe_owners:
        # count pairs before joint owners multiply the rows (the report default counts after)
        pairs = _with_contacts(_flagged_pairs(d, as_of), d)
    else:
        pairs = _flags_and_counts(_contact_pairs(d, as_of))
    return ds.attach_crm_counts(pairs, d, "tpklpaprop")


SINGLE_SERVICE_COLS = ["property_key", "tpklpaprop", "formatted_address", "suburb", "property_type"]
SINGLE_TAIL = ["service_bin_type", "service_frequency", "service_units", "avg_bin_size",
               "calculation_method", "number_service_records", "c_audit_date", "rate_property_key",
               "rate_type_key", "rate_units", "ratetype_key", "ratetype", "rate_bin_type",
               "rate_frequency", "assessment", "vgnumber", "number_rate_records"]


@ds._memo
def single_nonmatches(d: Domain, as_of, dedupe_owners: bool = False) -> DataFrame:
    """J1: single-dwelling service groups vs rates that disagree, perfect pairings suppressed,
    with ratepayer contact and CRM counts.  ``dedupe_owners`` counts pairs before joint owners
    repeat the rows (the source counts after, so its suppression weakens for joint owners)."""
    pairs = _single_pairs(d, as_of, contacts=True, dedupe_owners=dedupe_owners)
    out = reconcile_nonmatches(pairs, SINGLE_FLAGS, lead_flag="bin_type_mismatch",
                               n_left="number_service_records", n_right="number_rate_records",
                               matched="number_bin_matched", mismatched="number_bin_mismatched")
    out = out.select(*SINGLE_SERVICE_COLS, "assessment_key", *SINGLE_TAIL, "ratepayer_address",
                     "ratepayer_email", *SINGLE_FLAGS, "number_bin_matched",
                     "number_bin_mismatched", "number_bin_requests", "number_rates_impact",
                     "number_cw_impact")
    return sorted_report(out, "tpklpaprop")


@ds._memo
def single_matches(d: Domain, as_of) -> DataFrame:
    """J2: single-dwelling pairs where every compared attribute agrees."""
    pairs = _single_pairs(d, as_of, contacts=False)
    out = reconcile_matches(pairs, SINGLE_FLAGS).select(
        *SINGLE_SERVICE_COLS, *SINGLE_TAIL, *SINGLE_FLAGS, "number_bin_matched",
        "number_bin_mismatched")
    return sorted_report(out, "tpklpaprop")


# ============================================================================ J3 / J4
@ds._memo
def _shared_rows(d: Domain, as_of, crm: bool) -> DataFrame:
    pbr = d.reg_bserv_bin_services.select("c_audit_date", "property_key_link_to_property")
    j = ds.shared_volume(d, as_of).join(pbr, F.col("property_key_link_to_property") == F.col("parent_key"), "left")
    if crm:
        j = ds.attach_crm_counts(j, d, "parent_property_tpklpaprop")
    j = j.withColumns({
        "bin_type_mismatch": mismatch_flag("service_bin_type", "rate_bin_type", "0"),
        "frequency_mismatch": mismatch_flag("avg_frequency", "rate_frequency", 0),
        "rate_type_mismatch": code_flag("ratetype", 3, "M"),
        "formatted_address": F.coalesce("child_formatted_address", "parent_formatted_address"),
        "suburb": F.coalesce("child_suburb", "parent_suburb"),
    })
    return j


def _shared_disagree() -> Column:
    """Raw three-valued disagreement test (a null class test stays unknown)."""
    return ((F.coalesce(F.col("service_bin_type"), F.lit("0"))
             != F.coalesce(F.col("rate_bin_type"), F.lit("0")))
            | (F.coalesce(F.col("avg_frequency"), F.lit(0))
               != F.coalesce(F.col("rate_frequency"), F.lit(0)))
            | (F.substring("ratetype", 3, 1) != "M"))


SHARED_PARENT_COLS = ["parent_key", "parent_tpklpaprop", "parent_formatted_address", "parent_suburb",
                      "total_volume", "avg_frequency"]
SHARED_RATE_COLS = ["parent_property_key", "property_key", "parent_property_tpklpaprop",
                    "tpklpaprop", "eligible_properties", "child_formatted_address", "child_suburb",
                    "rate_type_key", "rate_units", "ratetype_key", "ratetype", "rate_bin_type",
                    "rate_frequency", "assessment", "vgnumber"]
SHARED_REG_COLS = ["c_audit_date", "property_key_link_to_property"]


@ds._memo
def shared_nonmatches(d: Domain, as_of) -> DataFrame:
    """J3: shared-dwelling parent volume band vs each rated child's rate, where they disagree."""
    j = _shared_rows(d, as_of, crm=True).where(_shared_disagree())
    j = j.select(*SHARED_PARENT_COLS, *SHARED_RATE_COLS, *SHARED_REG_COLS, "avg_bin_size",
                 "service_bin_type", "number_bin_requests", "number_rates_impact",
                 "number_cw_impact", *SHARED_FLAGS, "formatted_address", "suburb")
    return sorted_report(j, "parent_tpklpaprop", "tpklpaprop")


@ds._memo
def shared_matches(d: Domain, as_of) -> DataFrame:
    """J4: shared-dwelling rows where band, frequency and class all agree (unknown excluded)."""
    j = _shared_rows(d, as_of, crm=False).where(~_shared_disagree())
    j = j.select(*SHARED_PARENT_COLS, *SHARED_REG_COLS, *SHARED_RATE_COLS, "avg_bin_size",
                 "service_bin_type", *SHARED_FLAGS, "formatted_address", "suburb")
    return sorted_report(j, "parent_tpklpaprop", "tpklpaprop")


# ============================================================================ J5
def _sum0(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def _sums_per_activity(d: Domain, keep: Column, active: str, sums: dict[str, Column]) -> DataFrame:
    """Per property with service rows (``__ps_key``) and activity of their codes: how many rows there are
    that ``keep`` holds for, ``ps_rows`` (0: none of them), and ``sums`` over those.

    Services are summed before they meet the properties: a property with a third of all services is
    a row or two for each task that scans them, and no join has it on a side that cannot be split.
    """
    ps = d.property_services_facts.where(F.col("property_key").isNotNull()).select(
        F.col("property_key").alias("__ps_key"), F.col("service_code").alias("ps_code"),
        F.col("number_of_services").alias("ps_n"), F.col("status").alias("ps_status"),
        F.col("removal_date").alias("ps_removal"))
    sc = d.property_service_codes_custom.select(F.col("service_code").alias("__sc_code"),
                                                F.col("is_active").alias(active))
    return (ps.join(sc, F.col("ps_code") == F.col("__sc_code"), "left")
            .groupBy("__ps_key", active)
            .agg(F.count(F.when(keep, 1)).alias("ps_rows"), *[F.sum(F.when(keep, x)).alias(n) for n, x in sums.items()]))


@ds._memo
def _br_parent_side(d: Domain, as_of) -> DataFrame:
    """Per parentless current property and own-code activity: own service rows that pass the
    stream filter, summarised (count, active non-N0000UA, red, active, N0000UA).  A property
    without service rows keeps one null row; one whose rows all fail disappears."""
    p = d.property.where(F.col("parent_property_key").isNull() & (F.col("status") == "C")).select(
        "property_key", "tpklpaprop", "formatted_address", "suburb")
    code = F.col("ps_code")
    keep = code.like("R%") | ((F.col("ps_status") == "C") & code.like("G%") & (F.col("sc_active") == "No")) | code.like("N%")
    sums = _sums_per_activity(d, keep, "sc_active", _br_sums(as_of, "sc_active"))
    # every use of these sums is null-defaulted in the source (isnull(sum(..), 0))
    return (p.join(sums, F.col("property_key") == F.col("__ps_key"), "left")
            .where(F.col("__ps_key").isNull() | (F.col("ps_rows") > 0))
            .groupBy("property_key", "tpklpaprop", "formatted_address", "suburb", "sc_active")
            .agg(F.sum(F.coalesce("ps_rows", F.lit(1))).alias("ps_rows"),
                 *[_sum0(F.col(c)).alias(c) for c in ("ps_f", "ps_red", "ps_act", "ps_ua")]))


def _br_sums(as_of, active: str) -> dict[str, Column]:
    """What J5 sums over service rows: chargeable, red and active services, and rows of the special code."""
    code, n = F.col("ps_code"), F.col("ps_n")
    act = active_any("ps_status", "ps_removal", as_of)
    return {"ps_f": F.when(act & (code != "N0000UA"), n).otherwise(0), "ps_red": F.when(code.like("R%") & act, n).otherwise(0),
            "ps_act": F.when(act, n).otherwise(0), "ps_ua": F.when((code == "N0000UA") & (F.col(active) == "Yes"), 1).otherwise(0)}


@ds._memo
def _br_child_side(d: Domain, as_of) -> DataFrame:
    """Per child property and code activity: all its service rows, summarised."""
    cp = d.property.where(F.col("parent_property_key").isNotNull()).select(
        F.col("property_key").alias("cp_key"))
    sums = _sums_per_activity(d, F.lit(True), "csc_active", _br_sums(as_of, "csc_active"))
    return (cp.join(sums, F.col("cp_key") == F.col("__ps_key"), "left").groupBy("cp_key", "csc_active")
            .agg(F.sum(F.coalesce("ps_rows", F.lit(1))).alias("cps_rows"),
                 *[_sum0(F.col(c)).alias(f"c{c}") for c in ("ps_f", "ps_red", "ps_act", "ps_ua")]))


@ds._kept
def _br_rows(d: Domain, as_of) -> DataFrame:
    """Both service branches of J5, unioned."""
    ps = _br_parent_side(d, as_of)
    # parent x (current children, or none): a parent whose children are all historic drops out
    fam = with_children(ps, d.property, cols={
        "property_key": "cp_key", "tpklpaprop": "cp_tpk", "formatted_address": "cp_addr",
        "suburb": "cp_suburb", "status": "cp_status"})
    fam = fam.where(filter_optional("cp_status", F.col("cp_status") == "C"))
    fam = fam.join(_br_child_side(d, as_of), "cp_key", "left")
    n = F.col("ps_rows")
    m = F.coalesce(F.col("cps_rows"), F.lit(1))
    cf, cred, cact, cua = [F.coalesce(F.col(c), F.lit(0)) for c in ("cps_f", "cps_red", "cps_act", "cps_ua")]
    child_act = n * cact
    a, b = F.col("sc_active"), F.col("csc_active")
    branch1 = fam.select(
        F.coalesce("cp_key", "property_key").alias("property_key"),
        F.coalesce("cp_tpk", "tpklpaprop").alias("tpklpaprop"),
        F.col("tpklpaprop").alias("parent_tpklpaprop"),
        F.coalesce("cp_addr", "formatted_address").alias("formatted_address"),
        F.coalesce("cp_suburb", "suburb").alias("suburb"),
        (m * F.col("ps_f") + n * cf).alias("number_of_services"),
        (m * F.col("ps_red") + n * cred).alias("number_of_red_services"),
        F.when(child_act > 0, "Child Has Service").when(a.isNull(), "Missing Service")
        .when(m * F.col("ps_act") == 0, "Zero Service").when(a == "Yes", "Has Service")
        .when(a == "No", "Old Service Code").otherwise("Unknown").alias("service_category"),
        (n * m - (n - F.col("ps_ua")) * (m - cua)).alias("number_of_n0000ua"),
        F.when(b.isNotNull() & a.isNull(), "Yes").otherwise("No").alias("is_terrace_title"))
    branch2 = ps.select(
        "property_key", "tpklpaprop", F.col("tpklpaprop").alias("parent_tpklpaprop"),
        "formatted_address", "suburb", F.col("ps_f").alias("number_of_services"),
        F.col("ps_red").alias("number_of_red_services"),
        service_category("sc_active", "ps_act").alias("service_category"),
        F.col("ps_ua").alias("number_of_n0000ua"), F.lit("No").alias("is_terrace_title"))
    return branch1.unionByName(branch2)


@ds._memo
def _br_branches(d: Domain, as_of) -> DataFrame:
    """The rows of both branches with the per-register-id totals attached."""
    both = over_keys(_br_rows(d, as_of), ["tpklpaprop"], {"total_number_of_services": F.sum("number_of_services"),
                                            "__ua_total": F.sum("number_of_n0000ua")},
                     null_safe=False)
    return both.withColumn("has_n0000ua", F.when(F.col("__ua_total") > 0, "Yes").otherwise("No")) \
               .drop("__ua_total")


RWS_COLS = ["parent_tpklpaprop", "tpklpaprop", "formatted_address", "suburb", "assessment",
            "vgnumber", "ratetype", "ratepayer", "audit_date", "service_category", "has_n0000ua"]


@ds._kept_by("r_key")
def _rates_payer(d: Domain, as_of) -> DataFrame:
    return ds.current_rates(d, as_of).select(
        F.col("property_key").alias("r_key"), "assessment", "vgnumber", "ratetype",
        F.col("ratepayer_address_1").alias("ratepayer"))


@ds._memo
def _br_special(d: Domain, as_of) -> DataFrame:
    """J5 special branch: a current child with a current N0000UA service, manual calculation and
    a current rate, whose parent has no current service, no calculation method and no rate.

    The parent conditions are evaluated once per parent key (pre-aggregated), not per combination
    of parent service, registration and rate rows; the result is distinct either way.
    """
    psf = d.property_services_facts
    reg = d.reg_bserv_bin_services
    rates = ds.current_rates(d, as_of)
    par_svc = psf.groupBy(F.col("property_key").alias("pk")).agg(
        F.max(F.col("service_code").isNull().cast("int")).alias("has_null_code"))
    par_rate = rates.groupBy(F.col("property_key").alias("rk")).agg(
        F.max(F.col("ratetype").isNull().cast("int")).alias("has_null_rate"))
    par_reg = reg.groupBy(F.col("property_key_link_to_property").alias("gk")).agg(
        F.max(F.col("c_calculation_method").isNull().cast("int")).alias("has_null_method"))
    # a rate is looked up through a parent service row: without one there is none
    no_rate = F.col("pk").isNull() | F.col("rk").isNull() | (F.col("has_null_rate") == 1)
    no_method = F.col("gk").isNull() | (F.col("has_null_method") == 1)
    child = d.property.where((F.col("status") == "C") & F.col("parent_property_key").isNotNull()).select(
        "property_key", "parent_property_key", "parent_property_tpklpaprop", "tpklpaprop",
        "formatted_address", "suburb")
    ps = psf.where((F.col("status") == "C") & (F.col("service_code") == "N0000UA")).select(
        F.col("property_key").alias("__ps_key"))
    bs = reg.where(F.col("c_calculation_method").like("MAN%")).select(
        F.col("property_key_link_to_property").alias("__bs_key"), F.col("c_audit_date").alias("audit_date"))
    # the service rows only test existence (the result is distinct): semi-join, no row product
    j = (child.join(ps, F.col("property_key") == F.col("__ps_key"), "left_semi")
         .join(bs, F.col("property_key") == F.col("__bs_key"))
         .join(_rates_payer(d, as_of), F.col("property_key") == F.col("r_key"))
         .join(par_svc, F.col("parent_property_key") == F.col("pk"), "left")
         .join(par_rate, F.col("parent_property_key") == F.col("rk"), "left")
         .join(par_reg, F.col("parent_property_key") == F.col("gk"), "left")
         .where(no_rate & no_method))
    j = no_current(j, psf, "pk", "property_key", F.col("status") == "C",
                   unless=F.col("has_null_code") == 1)
    return j.select(F.col("parent_property_tpklpaprop").alias("parent_tpklpaprop"), "tpklpaprop",
                    "formatted_address", "suburb", "assessment", "vgnumber", "ratetype", "ratepayer",
                    "audit_date", F.lit("Child Has Service").alias("service_category"),
                    F.lit("Yes").alias("has_n0000ua"))


@ds._memo
def rates_without_services(d: Domain, as_of) -> DataFrame:
    """J5: rated parentless properties (and their children) without current services or with
    only old service codes, plus the N0000UA special case; distinct rows."""
    both = _br_branches(d, as_of)
    bs = d.reg_bserv_bin_services.select(F.col("property_key_link_to_property").alias("__bs_key"),
                                         F.col("c_audit_date").alias("audit_date"))
    main = (both.join(_rates_payer(d, as_of), F.col("property_key") == F.col("r_key"))
            .join(bs, F.col("property_key") == F.col("__bs_key"), "left")
            .where((F.col("ratetype") != "N0000UA")
                   & ((F.col("total_number_of_services") == 0)
                      | (F.col("service_category") == "Old Service Code"))
                   & (F.col("is_terrace_title") == "No"))
            .select(*RWS_COLS))
    return sorted_report(main.unionByName(_br_special(d, as_of)).distinct(), "tpklpaprop")


# ============================================================================ J6
@ds._kept_by("rates_property_key")
def _counted_rates(d: Domain, as_of) -> DataFrame:
    """Current rates with the number of rates of their property."""
    rates = ds.current_rates(d, as_of, with_assessment=False)
    rates = over_keys(rates, ["property_key"], {"number_of_rates": F.count("property_key")},
                      null_safe=False)
    return rates.select(F.col("property_key").alias("rates_property_key"), "rate_type_key",
                        F.col("units").alias("rate_units"),
                        F.coalesce(F.col("number_of_rates"), F.lit(0)).alias("number_of_rates"),
                        "ratetype_key", "ratetype", "rate_bin_type", "rate_frequency")


@ds._kept
def _unrated_families(d: Domain, as_of) -> DataFrame:
    """Heads without a current rate with their services, alone or with each child."""
    rates = _counted_rates(d, as_of)
    # A parent with any current rate fails "parent_number_of_rates = 0" on every row of its
    # family, and every per-family total is partitioned by the parent: drop such parents first.
    p = (d.property.where(F.col("parent_property_key").isNull() & (F.col("status") == "C"))
         .join(rates.select(F.col("rates_property_key").alias("__rk")),
               F.col("property_key") == F.col("__rk"), "left_anti")
         .select("property_key", "tpklpaprop", "formatted_address", "suburb"))
    code = F.col("ps_code")
    keep = (active_any("ps_status", "ps_removal", as_of)
            & (code.like("R%") | (code.like("G%") & F.col("sc_active").like("No%")) | code.like("N%")))
    # own services summarised per (parent, code activity) before meeting the parents and their children;
    # a parent without service rows has none in sum, and no red ones
    sums = _sums_per_activity(d, keep, "sc_active", {
        "ps_sum": F.col("ps_n"), "ps_red": F.when(F.left(code, F.lit(1)) == "R", F.col("ps_n")).otherwise(0)})
    own = (p.join(sums, F.col("property_key") == F.col("__ps_key"), "left")
           .where(F.col("__ps_key").isNull() | (F.col("ps_rows") > 0))
           .groupBy("property_key", "sc_active")
           .agg(F.sum("ps_sum").alias("ps_sum"),
                F.sum(F.when(F.col("__ps_key").isNull(), 0).otherwise(F.col("ps_red"))).alias("ps_red")))
    bsx = d.reg_bserv_bin_services.select(F.col("property_key_link_to_property").alias("__bs_key"),
                                          "c_calculation_method")
    asm = d.rate_assessment.select(F.col("tfklpaprop").alias("__a_tpk"),
                                   F.col("assessment").alias("parent_assessment"),
                                   F.col("vgnumber").alias("parent_vgnumber"))
    parents = p.select(*[F.col(c).alias(f"parent_{c}") for c in p.columns])
    fam = (with_children(parents, d.property, key="parent_property_key", parent_key="parent_property_key", cols={
               "property_key": "child_property_key", "tpklpaprop": "child_tpklpaprop",
               "formatted_address": "child_formatted_address", "suburb": "child_suburb", "status": "__cp_status"})
           .where(filter_optional("__cp_status", F.col("__cp_status") == "C"))
           .join(own, F.col("parent_property_key") == F.col("property_key"))
           .join(bsx, F.col("parent_property_key") == F.col("__bs_key"), "left")
           .join(asm, F.col("parent_tpklpaprop") == F.col("__a_tpk"), "left"))
    return (fam.groupBy("parent_property_key", "child_property_key", "parent_tpklpaprop",
                        "child_tpklpaprop", "parent_formatted_address", "child_formatted_address",
                        "parent_suburb", "child_suburb", "sc_active", "c_calculation_method",
                        "parent_assessment", "parent_vgnumber")
            .agg(F.coalesce(F.sum("ps_sum"), F.lit(0)).alias("number_of_services"),
                 F.sum("ps_red").alias("number_of_red_services")))


@ds._memo
def services_without_rates(d: Domain, as_of) -> DataFrame:
    """J6: parentless properties (and children) with services but no own or family rates."""
    rates = _counted_rates(d, as_of)
    g = _unrated_families(d, as_of)
    not_parking = (~F.col("child_formatted_address").like("Car Space%")
                   & ~F.col("child_formatted_address").like("Storage%"))
    # every family total hangs on the parent alone: one aggregate over the families, with the rates
    # of a property as one row (its n rate rows carry n each), joined back once
    own_rates = rates.groupBy(F.col("rates_property_key").alias("__total_key")).agg(
        F.sum("rate_units").alias("__units"), F.sum("number_of_rates").alias("__rates"))
    records = d.rate_assessment.groupBy(F.col("tfklpaprop").alias("__record_tpk")).agg(F.count(F.lit(1)).alias("__records"))
    times = F.coalesce(F.col("__records"), F.lit(1))
    totals = (g.withColumns({"__own": F.coalesce("child_property_key", "parent_property_key"),
                             "__own_tpk": F.coalesce("child_tpklpaprop", "parent_tpklpaprop")})
              .join(own_rates, F.col("__own") == F.col("__total_key"), "left")
              .join(records, F.col("__own_tpk") == F.col("__record_tpk"), "left")
              .groupBy(F.col("parent_property_key").alias("__family"))
              .agg(F.count("child_property_key").alias("number_of_all_child_properties"),
                   F.sum(F.when(not_parking, 1).otherwise(0)).alias("number_of_child_properties"),
                   F.coalesce(F.sum(F.col("__units") * times), F.lit(0)).alias("total_child_rate_units"),
                   F.coalesce(F.sum(F.col("__rates") * times), F.lit(0)).alias("total_child_rates")))
    # families with any rate unit are not reported
    totals = totals.where(F.col("total_child_rate_units") == 0)
    g = g.join(totals, F.col("parent_property_key") == F.col("__family")).drop("__family")
    g = g.select(
        F.coalesce("child_property_key", "parent_property_key").alias("property_key"),
        F.coalesce("child_tpklpaprop", "parent_tpklpaprop").alias("tpklpaprop"),
        F.coalesce("child_formatted_address", "parent_formatted_address").alias("formatted_address"),
        F.coalesce("child_suburb", "parent_suburb").alias("suburb"),
        "parent_property_key", "parent_tpklpaprop", "parent_formatted_address", "parent_suburb",
        "child_property_key", "child_tpklpaprop", "child_formatted_address", "child_suburb",
        "number_of_all_child_properties", "number_of_child_properties",
        F.lit(0).cast("bigint").alias("parent_number_of_rates"), "parent_assessment",
        "parent_vgnumber", "number_of_services", "number_of_red_services",
        service_category("sc_active", "number_of_services").alias("service_category"),
        F.coalesce(F.left(F.col("c_calculation_method"), F.lit(4)), F.lit("None"))
        .alias("calculation_method"), "total_child_rate_units", "total_child_rates")
    g = g.where((F.col("number_of_services") > 0) & ~F.col("formatted_address").like("Car Space%")
                & ~F.col("formatted_address").like("Storage%"))
    asm2 = d.rate_assessment.select("tfklpaprop", "assessment", "vgnumber")
    out = left_join_skew_safe(g.join(asm2, F.col("tpklpaprop") == F.col("tfklpaprop"), "left"),
                              rates, "property_key", "rates_property_key")
    return sorted_report(out, "parent_tpklpaprop", "child_tpklpaprop")


# ============================================================================ J7
@ds._memo
def historic_services(d: Domain, as_of) -> DataFrame:
    """J7: historic properties that still have current services, per service code."""
    p = d.property.where(F.col("status") == "H")
    ps = ds.m_services_facts(d).where(active_all("status", "removal_date", as_of)).select(
        F.col("property_key").alias("__ps_key"), "service_code", "number_of_services")
    out = (p.join(ps, F.col("property_key") == F.col("__ps_key"))
           .groupBy("property_key", "tpklpaprop", "formatted_address", "suburb", "service_code")
           .agg(F.sum("number_of_services").alias("number_of_services")))
    return sorted_report(out, "tpklpaprop")


# ============================================================================ J8
@ds._memo
def mailing_audit(d: Domain, register: int = 84) -> DataFrame:
    """J8: assessments whose mailing address (active override, else latest default address of the
    ratepayer) does not contain the address of the register entry's agent."""
    entry = d.crgntry.where(F.col("tfkcrgregs") == register)
    ngc = d.crgregv.where(F.col("tfkcrgfeld") == 953).select(
        F.col("tfkcrgntry").alias("__ngc_entry"), F.col("regfldvalu").alias("__ngc_value"))
    link = d.crgregv.where(F.col("tfkcrgfeld") == 954).select(
        F.col("tfkcrgntry").alias("__link_entry"), F.col("tpkcrgregv").alias("__link_id"))
    role = d.crgrole.where((F.col("fkcrgrolta") == "cna") & (F.col("fkcrgroltn") == 1)
                           & (F.col("status") == "c")).select(
        F.col("tfklocl").alias("__role_loc"), F.col("tfkappl").alias("__agent_id"))
    agent_addr = ds.effective_address(d).select(F.col("tfkcnaidty").alias("__agent_idty"),
                                                F.col("formataddr").alias("agent_address"))
    agents = d.cnaidty.select(F.col("tpkcnaidty").alias("__agent_tpk"))
    groups = d.lrantgp.select(F.col("tpklrantgp").alias("__ng_id"), F.col("ntgpcode").alias("notice_group_code"))
    assm = d.lraassm.where(F.col("status") == "c").select(
        F.col("tpklraassm").alias("__asm_id"), F.col("tfklrantgp").alias("__asm_ng"),
        F.col("assmnumber").alias("assessment"))
    prole = d.cnarole.where((F.col("fkcnarolta") == "lra") & (F.col("fkcnaroltn") == 0)
                            & (F.col("status") == "c")).select(
        F.col("tpkcnarole").alias("__prole_id"), F.col("tfkappl").alias("__prole_appl"),
        F.col("tfkcnaidty").alias("__prole_idty"))
    payer = d.cnaidty.select(F.col("tpkcnaidty").alias("name_key"), F.col("formatname").alias("ratepayer"))
    default_addr = ds.effective_address(d).select(F.col("tfkcnaidty").alias("__def_idty"),
                                                  F.col("formataddr").alias("default_address"))
    override = (ds.active_override_address(d).select(F.col("tfkcnarole").alias("__ovr_role"),
                                                     F.col("tfkcnaaddr").alias("__ovr_addr"))
                .join(d.cnaaddr.select(F.col("tpkcnaaddr").alias("__ovr_tpk"),
                                       F.col("formataddr").alias("override")),
                      F.col("__ovr_addr") == F.col("__ovr_tpk"), "left"))
    j = (entry.join(ngc, F.col("tpkcrgntry") == F.col("__ngc_entry"))
         .join(link, F.col("tpkcrgntry") == F.col("__link_entry"))
         .join(role, F.col("__link_id") == F.col("__role_loc"))
         .join(agents, F.col("__agent_tpk") == F.col("__agent_id"))
         .join(agent_addr, F.col("__agent_idty") == F.col("__agent_tpk"))
         .join(groups, F.col("notice_group_code") == F.col("__ngc_value"))
         .join(assm, F.col("__ng_id") == F.col("__asm_ng"))
         .join(prole, F.col("__asm_id") == F.col("__prole_appl"))
         .join(payer, F.col("name_key") == F.col("__prole_idty"))
         .join(default_addr, F.col("__def_idty") == F.col("name_key"))
         .join(override, F.col("__prole_id") == F.col("__ovr_role"), "left"))
    mailing = F.coalesce(F.col("override"), F.col("default_address"))
    return (j.where(not_contains(mailing, F.col("agent_address")))
            .select(F.col("keyval").alias("reference_no"), "name_key", "notice_group_code",
                    "ratepayer", "assessment", "agent_address", "override", "default_address",
                    mailing.alias("assessment_mailing_address")))


# ============================================================================ J9 / J10
# Display headings of J9.
J9_HEADINGS = {"formatted_address": "Formatted address", "tpklpaprop": "TPK",
               "formatted_owner_name": "Owner(s)", "service_category": "Service category",
               "calculation_method": "Calculation method"}


@ds._memo
def services_without_rates_m(d: Domain, as_of) -> DataFrame:
    """J9 (M form): parent properties with services but no own rates and no child rate units."""
    j = nested_join(ds.m_parent_properties(d), ds.m_assessment_info(d), ["tpklpaprop"], ["tfklpaprop"],
                    ["vgnumber"], null_keys=False)
    j = nested_join(j, ds.m_property_services(d, as_of), ["property_key"], ["property_key"],
                    ["number_of_services", "number_of_red_services", "service_category"], null_keys=False)
    j = nested_join(j, ds.m_bin_services_info(d), ["property_key"], ["property_key"],
                    ["calculation_method"], null_keys=False)
    j = nested_join(j, ds.m_property_rates(d, as_of), ["property_key"], ["property_key"],
                    ["number_of_rates", "rate_units"], null_keys=False)
    j = nested_join(j, ds.m_child_rates_totals(d, as_of), ["property_key"], ["property_key"],
                    ["total_child_rates", "total_child_rate_units", "total_child_props"], null_keys=False)
    j = j.fillna(0, subset=["number_of_services", "number_of_red_services", "number_of_rates",
                            "rate_units", "total_child_rates", "total_child_rate_units",
                            "total_child_props"])
    j = j.where(m_filter((F.col("number_of_services") > 0) & m_eq("total_child_rate_units", 0)
                         & m_eq("number_of_rates", 0)))
    j = j.withColumns({"formatted_owner_name": trim_end("formatted_owner_name"),
                       "assessment": F.col("assessment").cast("string")})
    return j.withColumnsRenamed(J9_HEADINGS)


@ds._memo
def m_sud_audit(d: Domain, as_of) -> DataFrame:
    j = nested_join(ds.m_sud_properties(d), ds.m_sud_services(d, as_of), ["property_key"],
                    ["property_key"], ["number_of_services", "number_of_red_services",
                                       "service_category"], null_keys=False)
    j = nested_join(j, ds.m_sud_rates(d, as_of), ["property_key"], ["property_key"],
                    ["ratetype", "vgnumber", "ratepayer"], how="inner", null_keys=False)
    j = nested_join(j, d.reg_bserv_bin_services, ["property_key"], ["property_key_link_to_property"],
                    {"c_audit_date": "audit_date"}, null_keys=False)
    j = (j.fillna(0, subset=["number_of_services", "number_of_red_services"])
         .fillna("Missing Service", subset=["service_category"])
         .withColumns({"parent_tpklpaprop": F.col("tpklpaprop"), "has_n0000ua": F.lit("No")}))
    j = j.where(m_filter(m_eq("number_of_services", 0) | m_eq("service_category", "Old Service Code")))
    return j.select(*RWS_COLS)


@ds._memo
def m_mud_audit(d: Domain, as_of) -> DataFrame:
    j = nested_join(ds.m_child_rates(d, as_of), ds.m_mud_parent_properties(d), ["parent_property_key"],
                    ["property_key"], {"tpklpaprop": "parent_tpklpaprop",
                                       "formatted_address": "parent_formatted_address",
                                       "suburb": "parent_suburb"}, how="inner", null_keys=False)
    j = nested_join(j, ds.m_parent_child_service_aggregation(d, as_of), ["parent_property_key"],
                    ["property_key"], ["total_number_of_services", "service_category", "has_n0000ua"], null_keys=False)
    j = nested_join(j, d.reg_bserv_bin_services, ["property_key"], ["property_key_link_to_property"],
                    {"c_audit_date": "audit_date"}, null_keys=False)
    j = (j.fillna(0, subset=["total_number_of_services"])
         .fillna("Missing Service", subset=["service_category"])
         .fillna("No", subset=["has_n0000ua"]))
    j = j.where(m_filter(m_eq("total_number_of_services", 0)
                         | m_eq("service_category", "Old Service Code")))
    return j.select("parent_tpklpaprop", F.col("child_tpklpaprop").alias("tpklpaprop"),
                    F.col("child_formatted_address").alias("formatted_address"),
                    F.col("child_suburb").alias("suburb"), "assessment", "vgnumber", "ratetype",
                    "ratepayer", "audit_date", "service_category", "has_n0000ua")


@ds._memo
def m_mud_special(d: Domain, as_of) -> DataFrame:
    psf = ds.m_services_facts(d)
    reg = d.reg_bserv_bin_services
    j = ds.m_child_properties(d).where(m_filter(m_eq("status", "C")))
    j = nested_join(j, ds.m_mud_parent_properties(d), ["parent_property_key"], ["property_key"],
                    {"tpklpaprop": "parent_tpklpaprop"}, how="inner", null_keys=False)
    j = nested_join(j, psf, ["property_key"], ["property_key"],
                    {"service_code": "service_code", "status": "service_status"}, how="inner", null_keys=False)
    j = j.where(m_filter(m_eq("service_code", "N0000UA") & m_eq("service_status", "C")))
    j = nested_join(j, ds.m_child_rates(d, as_of), ["property_key"], ["property_key"],
                    ["vgnumber", "ratepayer", "ratetype"], how="inner", null_keys=False)
    j = nested_join(j, reg, ["property_key"], ["property_key_link_to_property"],
                    {"c_calculation_method": "child_calc_method", "c_audit_date": "audit_date"},
                    how="inner", null_keys=False)
    j = j.where(m_filter(m_eq(F.left(F.col("child_calc_method"), F.lit(3)), "MAN")))
    # "no parent service": left join to the parent's (status C) services, keep rows whose code is null
    # or status is not C.  Only such service rows are joined; a parent that has services, but none of
    # them, is dropped through its key among the distinct service keys.
    passing = psf.where(F.col("service_code").isNull() | m_filter(m_ne("status", "C"))).select(
        F.col("property_key").alias("__passing"))
    any_key = psf.select(F.col("property_key").alias("__any")).distinct()
    j = left_join_skew_safe(j, passing, "parent_property_key", "__passing")
    j = (j.join(any_key, F.col("parent_property_key") == F.col("__any"), "left")
         .where(F.col("__passing").isNotNull() | F.col("__any").isNull()).drop("__passing", "__any"))
    j = nested_join(j, reg, ["parent_property_key"], ["property_key_link_to_property"],
                    {"c_calculation_method": "parent_calc_method"}, null_keys=False)
    j = j.where(F.col("parent_calc_method").isNull())
    j = nested_join(j, ds.m_parent_rates(d, as_of), ["parent_property_key"], ["property_key"],
                    {"ratetype": "parent_ratetype"}, null_keys=False)
    j = j.where(F.col("parent_ratetype").isNull())
    j = j.withColumns({"service_category": F.lit("Child Has Service"), "has_n0000ua": F.lit("Yes")})
    return j.select(*RWS_COLS)


# Display headings of J10.
J10_HEADINGS = {"parent_tpklpaprop": "parent tpk", "tpklpaprop": "tpk", "formatted_address": "address",
                "ratetype": "rate type", "ratepayer": "rate payer", "audit_date": "audit date",
                "service_category": "service category", "has_n0000ua": "has n0000ua?"}


@ds._memo
def rates_without_services_m(d: Domain, as_of) -> DataFrame:
    """J10 (M form): single-dwelling audit + multi-dwelling audit + N0000UA special, no dedupe."""
    u = (m_sud_audit(d, as_of).unionByName(m_mud_audit(d, as_of), allowMissingColumns=True)
         .unionByName(m_mud_special(d, as_of), allowMissingColumns=True))
    u = u.withColumns({"assessment": F.col("assessment").cast("string"),
                       "parent_tpklpaprop": F.col("parent_tpklpaprop").cast("bigint")})
    return u.withColumnsRenamed(J10_HEADINGS)

