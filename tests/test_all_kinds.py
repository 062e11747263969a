"""All kinds of anchor, and the templates they fill, by brute force."""

from collections import defaultdict

from harness import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corrobora.plans.roles import claims


def test_all_kinds_of_anchor(spark):
    rows = claims(spark, SMALL).select("claim_id", "state", "segment", F.date_format("loss_date", "yyyy-MM-dd").alias("day"), *[
        F.date_format(F.date_add("loss_date", i), "yyyy-MM-dd").alias(f"d{n}") for n, i in enumerate((-1, 0, 1, 2))
    ]).collect()
    got, tokens = set(), defaultdict(set)
    for r in entry.queries()["enr4_anchors_all_kinds"](spark, SMALL).collect():
        if r.kind == "token":
            tokens[r.claim_id].add(r.value)
        else:
            got.add((r.claim_id, r.kind, r.value))
    want, terms = set(), set()
    for r in rows:
        k, place = r.claim_id, r.state.lower().split("_")[0]
        name, plate = "Anil " + r.segment.capitalize(), f"MH{k % 50 + 1}AB{k % 10000:04d}"
        values = {
            "plate": [plate], "name": [name], "org": ["Gupta Roadways"], "place": [place], "corridor": [f"NH-{k % 90}"],
            "vehicle": ["truck"], "incident": ["overturn", "overturned", "killed", "injured", "police"],
            "police_station": ["Kharadi Police Station"], "hospital": ["Ruby Hospital Pune"], "date": [r.day],
            "window": [r.d0, r.d1, r.d2, r.d3], "count": [str(k % 9 + 1)], "injured": [str(k % 7 + 2)],
        }
        want |= {(k, kind, v) for kind, vs in values.items() for v in vs}
        tiers = {
            1: [f"{plate} accident", f"{plate} {place}", f'"{name}" {place} accident', f'"{name}" accident FIR',
                '"Gupta Roadways" overturn', f'"Gupta Roadways" {place}'],
            2: [f"{place} truck overturn", f"{place} overturn {r.day}", f"{place} {k % 9 + 1} killed overturn",
                f"{place} {k % 7 + 2} injured overturn", f"NH-{k % 90} {place} accident"],
            3: [f"Kharadi Police Station {place} accident FIR"],
            4: [f"site:youtube.com {plate}", f"site:youtube.com {place} overturn", f"Ruby Hospital Pune overturn {place}"],
        }
        terms |= {(k, tier, q) for tier, qs in tiers.items() for q in qs}
    assert got == want
    assert len(tokens) == len(rows) and all(len(t) == 8 for t in tokens.values())
    plan = entry.queries()["enr6_plan_terms_all_kinds"](spark, SMALL).collect()
    assert {tuple(r) for r in plan} == terms and len(plan) == len(terms)
