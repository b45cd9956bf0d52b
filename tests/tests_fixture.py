"""Small random registers full of nulls, for the tests."""

import random
from datetime import datetime

from tallyframe.sources.domain import SERVICE_CODES, Domain

SCHEMAS = {
    "property": "property_key bigint, tpklpaprop bigint, parent_property_key bigint, "
                "parent_property_tpklpaprop bigint, status string, property_type string, "
                "formatted_address string, address string, suburb string, street string, "
                "parent_property_address string, formatted_owner_name string, owners_na_slab_1 string, "
                "owners_na_slab_2 string, owners_na_slab_3 string, owners_na_slab_4 string, "
                "owners_na_slab_5 string, assessment_key bigint, assessment bigint",
    "property_services_facts": "property_key bigint, tpklpaprop bigint, service_code string, "
                               "container_type string, number_of_collections int, "
                               "number_of_services int, status string, removal_date timestamp_ntz",
    "reg_bserv_bin_services": "property_key_link_to_property bigint, c_calculation_method string, "
                              "c_audit_date timestamp_ntz",
    "rate_type_facts": "property_key bigint, rate_type_key bigint, units int, ratetype_key bigint, "
                       "assessment_key bigint, suspended_date timestamp_ntz",
    "rate_assessment": "assessment_key bigint, assessment bigint, vgnumber string, tfklpaprop bigint, "
                       "ratepayer_address_1 string, ratepayer_address_2 string, ratepayer_address_3 string, "
                       "ratepayer_address_4 string, ratepayer_address_5 string",
    "property_assessment_links": "tfklpaprop bigint, assessment_key bigint",
    "property_owners": "property_key bigint, owner_seq int",
    "names_applications": "tfkappl bigint, application string, role_description string, name_key bigint",
    "names": "name_key bigint, email string",
    "onecrm_request_questions": "request_facts_key bigint, questionnaire string, question string, answer string",
    "onecrm_task_information": "propertykey bigint, taskstatus string, tasktype string",
}


def random_registers(seed: int) -> dict[str, list[tuple]]:
    rnd = random.Random(seed)
    pick = rnd.choice
    dates = [None, datetime(1997, 1, 1), datetime(1999, 1, 1)]
    props = []
    for k in range(1, 41):
        parent = pick([None, None, rnd.randint(1, 8)]) if k > 8 else None
        addr = pick(["Car Space 1", "Storage 2", f"{k} Main St", f"{k} High St"])
        props.append((k, 1000 + k, parent, None if parent is None else 1000 + parent,
                      pick(["C"] * 5 + ["H", None]), pick(["RESIDENCE"] * 5 + ["STRCARSPC", "UTILITY", None]),
                      addr, addr, pick(["North", "South"]), "Road", None, f"owner {k}  ", f"o{k}",
                      None, None, None, None, 500 + k, 700 + k))
    codes = ["R0001"] * 6 + [c for c, _ in SERVICE_CODES] + ["R0002", "X9", None]
    psf = [(pick(list(range(1, 41)) + [49, 50]), 1000, pick(codes), pick(["40", "80", "80", "120", "240", "", "BULK", None]),
            rnd.randint(1, 2), pick([1, 1, 1, 0, 2, 3, None]), pick(["C", "C", "C", "H", None]),
            pick(dates)) for _ in range(220)]
    psf = [(k, 1000 + k if k % 7 else 2000 + k, *rest) for (k, _, *rest) in psf]
    reg = [(k, pick(["SNG1", "SNG1", "SHA1", "MAN1", None]), datetime(1998, 3, 31))
           for k in range(1, 41) if rnd.random() < 0.85]
    reg += [(rnd.randint(1, 40), "MAN1", datetime(1998, 4, 1)) for _ in range(3)]
    rtf = [(pick(list(range(1, 41)) + [49, 50]), i, pick([1, 1, 2]), pick(list(range(15)) + [0, 2, 6, 6, 6, 7]),
            500 + rnd.randint(1, 41), pick([None, None, None, datetime(1997, 1, 1), datetime(1999, 1, 1)]))
           for i in range(140)]
    ra = [(500 + k, 700 + k, str(k), 1000 + k, pick([f"payer {k} ", None]), pick(["Unit 2", None]),
           pick(["PO Box", None]), None, pick(["x", None])) for k in range(1, 41)]
    pal = [(1000 + k, 500 + k) for k in range(1, 41) if rnd.random() < 0.9]
    owners = [(k, i) for k in range(1, 41) for i in range(1, pick([1, 1, 2, 3]) + 1)]
    na = [(500 + k, pick(["LRA", "X"]), pick(["Ratepayer", "Ratepayer", "Agent"]), k) for k in range(1, 41)]
    names = [(k, pick([f"{k}@example.org", None])) for k in range(1, 41)]
    qs = ["New bin", "Remove bin", "Repair or replace bin", "Upsize or downsize bin", "Other"]
    orq = []
    for e in range(60):
        q = pick(qs)
        orq.append((e, q, "PropertyKey", pick([str(1000 + rnd.randint(1, 40)), "junk", None])))
        for _ in range(pick([0, 1, 1, 2])):
            orq.append((e, q, "CaseStatus", pick(["Submitted", "Approved", "Closed", "Under Review", None])))
    oti = [(1000 + rnd.randint(1, 40), pick(["In Progress", "Closed", None]),
            pick(["DW Charge Impact", "DW Charge Impact possible"])) for _ in range(50)]
    # fixed families so that every report branch has rows: a shared family whose children's
    # rates match the parent's band and frequency (41-43), a multi-dwelling parent without
    # services (44, 45), a single dwelling whose service and rate agree (46)
    def prop(k, parent=None):
        return (k, 1000 + k, parent, None if parent is None else 1000 + parent, "C", "RESIDENCE",
                f"{k} Fixed St", f"{k} Fixed St", "North", "Road", None, f"owner {k}", f"o{k}",
                None, None, None, None, 500 + k, 700 + k)
    # and a multi-dwelling parent whose only services have no code, with an N0000UA child on
    # manual calculation (47, 48)
    props += [prop(41), prop(42, 41), prop(43, 41), prop(44), prop(45, 44), prop(46), prop(47),
              prop(48, 47)]
    psf += [(41, 1041, "R0001", "120", 2, 1, "C", None), (46, 1046, "R0001", "80", 1, 1, "C", None),
            (47, 1047, None, "80", 1, 1, "C", None), (47, 1047, None, "80", 1, 1, "C", None),
            (48, 1048, "N0000UA", "80", 1, 1, "C", None)]
    reg += [(41, "SHA1", datetime(1998, 3, 31)), (46, "SNG1", datetime(1998, 3, 31)),
            (48, "MAN1", datetime(1998, 3, 31))]
    rtf += [(42, 900, 1, 9, 542, None), (43, 901, 1, 9, 543, None), (45, 902, 1, 9, 545, None),
            (46, 903, 1, 0, 546, None), (48, 904, 1, 6, 548, None)]
    ra += [(500 + k, 700 + k, str(k), 1000 + k, f"payer {k}", None, None, None, None)
           for k in range(41, 49)]
    return {"property": props, "property_services_facts": psf, "reg_bserv_bin_services": reg,
            "rate_type_facts": rtf, "rate_assessment": ra, "property_assessment_links": pal,
            "property_owners": owners, "names_applications": na, "names": names,
            "onecrm_request_questions": orq, "onecrm_task_information": oti}


class FixtureDomain(Domain):
    def __init__(self, spark, tables):
        super().__init__(spark, "<fixture>")
        self._views.update(tables)


def build(spark, seed):
    rows = random_registers(seed)
    tables = {n: spark.createDataFrame(rows[n], SCHEMAS[n]) for n in SCHEMAS}
    d = FixtureDomain(spark, tables)
    d._views["rate_type"] = d.build_rate_type()
    d._views["property_service_codes_custom"] = d.build_property_service_codes_custom()
    d._views["reg_bband_bin_bands"] = d.build_reg_bband_bin_bands()
    return d
