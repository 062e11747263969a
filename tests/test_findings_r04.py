"""Findings of round 4: the same results by cheaper expressions, on odd texts."""

import re

from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.functions.counts import first_count, reported_counts
from corrobora.functions.dates import parse_flexible_date
from corrobora.functions.identifiers import extract_plates, redact_identifiers
from corrobora.functions.phonetics import INDIC_DIGITS, normalise_digits
from corrobora.operators import anchors as N
from corrobora.operators import fields as FD
from corrobora.operators import ranking as R
from corrobora.sources.registers import header_match, is_header


def told(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, t STRING").repartition(2)
    return [r[1:] for r in sorted(df.select("id", *columns).collect())]


def test_native_digits_are_not_tested_one_by_one(spark):
    texts = ["", None, "plain 12", "é ü", "हिन्दी", "१२ मई", "".join(INDIC_DIGITS), "೦-௫-９-٣"]
    want = [None if t is None else "".join(str(INDIC_DIGITS.index(c) % 10) if c in INDIC_DIGITS else c for c in t) for t in texts]
    assert [r[0] for r in told(spark, texts, normalise_digits(F.col("t")))] == want
    # A pattern that lists all digits goes through the list for each letter of a text.
    plan = spark.createDataFrame([("",)], "t STRING").select(normalise_digits(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "translate" in plan.lower() and f"[{INDIC_DIGITS}]" not in plan


def test_counts_of_texts_with_and_without_outcome(spark):
    texts = ["Seventeen Persons KILLED, 3 dead", "three deaths", "death of 2", "killed 4 people", "unkilled 5", "x7 killed", "७ dead", "none", None, "20 INJURED"]
    got = told(spark, texts, first_count(F.col("t")), first_count(F.col("t"), ["injured", "hurt?"]), reported_counts(F.col("t")))
    assert [r[0] for r in got] == [17, 3, 2, 4, None, None, 7, None, None, None]
    assert [r[1] for r in got] == [None] * 9 + [20]
    assert [r[2] for r in got] == [[17, 3], [3], [], [], [], [], [7], [], None, []]


def test_dates_in_every_form(spark):
    cells = {
        "1995-01-02": "1995-01-02", "2/13/99": "1999-02-13", "13/2/49": "2049-02-13", "x 31.02.2001 y 2000-1-1": "2000-01-01", "31.02.2001": "2001-03-03",
        "2001-13-01 1/2/2003": None, "5 March 2020": "2020-03-05", "sept 7, 2021": "2021-09-07", "45000": "2023-03-15", "45000.75": "2023-03-15",
        "12345": None, "1-2-345": "0345-02-01", "1/2/3/4": None, "१२/०३/२०२०": "2020-03-12", "n/a": None, "": None, None: None,
    }
    got = told(spark, list(cells), parse_flexible_date(F.col("t")).cast("string"))
    assert {t: r[0] for t, r in zip(cells, got)} == cells


def test_anchor_patterns_on_odd_texts(spark):
    cells = [
        ("MUMBAI-PUNE Expressway, Ring expressway; near toll  plaza, NH 48 and xNH 7", ["PUNE Expressway", "Ring expressway", "toll plaza", "NH 48"]),
        ("robbed by Rob at the FLYOVER", ["Rob", "FLYOVER"]), ("nothing here", []), ("", []), (None, None),
    ]
    assert [r[0] for r in told(spark, [t for t, _ in cells], N.extract_corridors(F.col("t")))] == [v for _, v in cells]
    orgs = [("M/s. Shree  Ram Gupta Roadways Pvt. Ltd", ["Shree Ram Gupta Roadways Pvt."]), ("travelsome A1 TRAVELS", ["travelsome A1 TRAVELS"]), ("none", []), (None, None)]
    assert [r[0] for r in told(spark, [t for t, _ in orgs], N.extract_orgs(F.col("t")))] == [v for _, v in orgs]
    places = [
        ("at Old Town Police  Station", "Old Town Police  Station", None), ("aPune Thana Pune Thana", "Thana Pune Thana", None),
        ("the City  Care Hospital Pune.", None, "City Care Hospital Pune"), ("police hospital", None, None), ("", None, None), (None, None, None),
    ]
    assert told(spark, [p[0] for p in places], N.police_station(F.col("t")), N.hospital(F.col("t"))) == [p[1:] for p in places]
    plates = [("mh-12-ab-1234, KA01 234; xMH12AB1234 22 BH 1234 AA ZZ12AB1234", ["MH12AB1234", "KA01234", "22BH1234AA"]), ("", []), (None, None)]
    assert [r[0] for r in told(spark, [t for t, _ in plates], extract_plates(F.col("t")))] == [v for _, v in plates]
    names = [("owner Asha Rao and driver. Ravi Kumar, codriver Not Me", ["Asha Rao", "Ravi Kumar"])]
    assert [r[0] for r in told(spark, [t for t, _ in names], N.extract_names(F.col("t")))] == [v for _, v in names]


def test_leading_tokens_with_and_without_repeats(spark):
    texts = ["Élan ǅungla zebra 1234 12ab", "tok tok tok Tok other", "the and 12", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, t STRING")
    at_row = {(r.id, x.token, x.pos, x.token_score, n + 1) for r in df.select("id", R.leading_tokens(F.col("t"), 3).alias("l")).collect() for n, x in enumerate(r.l or [])}
    of_rows = {tuple(r) for r in R._top_tokens_of_rows(df, "id", "t", 3, None).select("id", "token", "pos", "token_score", "ordinal").collect()}
    assert at_row == of_rows and len(at_row) == 4


SHEET = "Claim No : CL123456\nInsured Name | Asha Rao | Loss City | n/a\n\nLoss City:\nPune\nDriver Name: Insured Name\nclaim no | CL 99\nThe City : Nagpur"


def test_fields_are_chosen_in_the_documents_row(spark):
    fields = ["claim_id", "insured_name", "accident_location_city", "driver_name"]
    want = ("CL123456", 0.95, "Asha Rao", 0.95, "Pune", 0.95, None, None)
    one = spark.createDataFrame([(1, SHEET), (2, "nothing\nhere"), (3, None), (4, "The City : Nagpur")], "k INT, t STRING")
    got = FD.parse_fields(one, "k", "t", fields)
    assert sorted(tuple(r) for r in got.collect()) == [(1, *want), (4, None, None, None, None, "Nagpur", 0.8, None, None)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # Documents in several rows, or without a key, are read as one.
    half = SHEET.split("\n\n")
    several = spark.createDataFrame([(1, half[0]), (1, half[1]), (None, half[1]), (None, half[0]), (2, SHEET)], "k INT, t STRING")
    both = FD.parse_fields(several, "k", "t", fields)
    assert both.columns == got.columns
    assert {tuple(r) for r in both.collect()} == {(1, *want), (None, *want), (2, *want)}


def test_labels_that_are_synonyms_are_looked_up(spark):
    table = [("a", "city"), ("b", "city"), ("c", "loss city"), ("d", "no")]
    labels = {"City": (1004, "a"), "loss  CITY": (1009, "c"), "the city": (504, "a"), "city of": (604, "a"), "no": (1002, "d"), "know": None, "x loss city y": (409, "c"), "": None, None: None}
    got = told(spark, list(labels), header_match(F.col("t"), table), is_header(F.col("t"), table))
    assert {t: r[0] and tuple(r[0]) for t, r in zip(labels, got)} == labels
    assert [r[1] for r in got] == [w is not None and w[0] > 1000 for w in labels.values()]


def test_redaction_strips_only_what_may_hold_a_shape(spark):
    shapes = K.SENSITIVE_SHAPES + K.DEBRIS_SHAPES
    samples = ["ABCDE1234F", "ab 123456", "+91 98765 43210", "a@b.c", "A1-B2-C3-D4-E5", "a|b", "x..y", "a#b", "a : b", "a :b", "a, b; c"]
    assert all(re.search(K.SHAPE_SIGNS, s) for s in samples) and all(any(re.search(p, s) for s in samples) for p in shapes)
    cells = {
        'MH12AB1234 "Anil Rao" accident': 'MH12AB1234 "Anil Rao" accident', "NH-4 Pune 2020-01-02 x": "NH-4 Pune 2020-01-02 x", "Pune 5 killed ABCDE1234F": "Pune 5 killed",
        "plain / - words": "plain words", "a\u0001b": "ab", "mail me@x.org, Pune; [now]": "mail Pune now", "": "", None: None,
    }
    got = told(spark, list(cells), redact_identifiers(F.col("t")))
    assert {t: r[0] for t, r in zip(cells, got)} == cells


def test_anchors_of_a_claim_without_a_date_and_with_repeats(spark):
    rows = [(1, ["MH-12-AB-1234", "mh12ab1234"], "Asha Rao", "ASHA RAO", "", "Pune, pune", None, "driver Asha Rao MH12AB1234 on NH 4 and nh 4"), (2, None, None, None, None, None, "1/2/2003", None)]
    claims = spark.createDataFrame(rows, "claim_id INT, vehicle_numbers ARRAY<STRING>, insured_name STRING, driver_name STRING, police_station STRING, loss_location STRING, loss_date_raw STRING, narrative STRING")
    kinds = [k for k in N.ANCHOR_KINDS if k != "token"]
    packed = N.claim_anchors(claims, kinds=kinds)
    got = {(r.claim_id, a.kind, a.value, a.ordinal) for r in packed.collect() for a in r.anchors}
    window = {(2, "window", f"2003-{d}", i) for i, d in enumerate(("01-31", "02-01", "02-02", "02-03"))}
    assert got == {(1, "plate", "MH12AB1234", 0), (1, "name", "Asha Rao", 0), (1, "place", "pune", 0), (1, "corridor", "nh 4", 0), (2, "date", "2003-02-01", 0)} | window
    counts = {tuple(r) for r in N.anchor_counts(packed).collect()}
    assert counts == {("plate", 1, 1), ("name", 1, 1), ("place", 1, 1), ("corridor", 1, 1), ("date", 1, 1), ("window", 4, 1)}
