"""Column functions on small invented inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from corrobora.functions import counts, dates, html, identifiers, phonetics, text, urls
from corrobora.operators import anchors
from corrobora.session import values_frame


def ev(spark, value, fn, kind="STRING"):
    df = values_frame(spark, [(value,)], f"v {kind}")
    return df.select(fn(F.col("v")).alias("r")).first().r


KEEP = [
    "MH12AB1234 accident", "UP-85 AT 9988 Loni", "NH-48 crash", "Loni overturn 2024-02-03", "Loni 03/02/2024", "Anil Rao accident FIR",
    "site:video.example Loni",
]
STRIP = [
    ("policy ABCDE1234F claim", "ABCDE1234F"), ("CL 26140317 Loni", "26140317"), ("call 9876543210 now", "9876543210"),
    ("mail a.b@c.example.org here", "a.b@c.example.org"), ("chassis MA3ERLF1S00123456", "MA3ERLF1S00123456"),
    ("account 1234 5678 9012 3456", "1234 5678"), ("gst 27ABCDE1234F1Z5", "27ABCDE1234F1Z5"), ("P/12345678", "12345678"),
]


@pytest.mark.parametrize("query", KEEP)
def test_redaction_keeps(spark, query):
    assert ev(spark, query, identifiers.redact_identifiers) == query


@pytest.mark.parametrize("query,secret", STRIP)
def test_redaction_strips(spark, query, secret):
    assert secret not in ev(spark, query, identifiers.redact_identifiers)


def test_redaction_keeps_what_it_must_next_to_secrets(spark):
    got = ev(spark, "MH12AB1234 claim CL 26140317 on 2024-02-03, NH 48; x@y.example", identifiers.redact_identifiers)
    assert got == "MH12AB1234 claim on 2024-02-03 NH 48"


def test_plates(spark):
    assert ev(spark, "mh-12 ab.1234", identifiers.normalise_plate) == "MH12AB1234"
    assert ev(spark, "22 BH 1234 A", identifiers.normalise_plate) == "22BH1234A"
    assert ev(spark, "ZZ12AB1234", identifiers.normalise_plate) is None
    assert ev(spark, "new---", identifiers.normalise_plate) is None
    assert ev(spark, "UP-85-AT-9988", identifiers.plate_forms) == [
        "UP85AT9988", "UP-85-AT-9988", "UP 85 AT 9988", "UP85AT 9988", "UP 85AT9988",
    ]
    assert "KA1AB1234" in ev(spark, "KA1AB1234", identifiers.plate_forms)
    assert ev(spark, "hit by UP 85 AT 9988 and ZZ12AB1234", identifiers.extract_plates) == ["UP85AT9988"]


@pytest.mark.parametrize(
    "raw,day",
    [
        ("2024-02-03", datetime.date(2024, 2, 3)), ("03/02/2024", datetime.date(2024, 2, 3)), ("02-13-2024", datetime.date(2024, 2, 13)),
        ("3.2.24", datetime.date(2024, 2, 3)), ("3.2.75", datetime.date(1975, 2, 3)), ("31/02/2024", datetime.date(2024, 3, 2)),
        ("12 August 2026", datetime.date(2026, 8, 12)), ("Aug 12, 2026", datetime.date(2026, 8, 12)), ("45000", datetime.date(2023, 3, 15)),
        ("Mon, 12 Aug 2024 10:00:00 GMT", datetime.date(2024, 8, 12)), ("१२/०८/२०२४", datetime.date(2024, 8, 12)), ("n/a", None), ("45/45/2024", None),
    ],
)
def test_flexible_date(spark, raw, day):
    assert ev(spark, raw, dates.parse_flexible_date) == day


def test_calendar_day(spark):
    got = lambda t: ev(spark, t, lambda c: dates.calendar_day(c.cast("timestamp_ntz")))
    assert got("2024-11-01 23:59:50") == datetime.date(2024, 11, 2)
    assert got("2024-11-02 00:00:00") == datetime.date(2024, 11, 2)
    assert got("2024-11-02 12:00:00") == datetime.date(2024, 11, 2)


PLACES = ["Chomu", "Chennai", "Jaipur", "Jodhpur", "Loni", "Lonavala", "Rewari", "Rewa", "Mathura", "Madurai", "Sikar", "Sagar", "Kota", "Kolkata", "Bharatpur"]


def test_phonetic_key_joins_spellings_and_keeps_places_apart(spark):
    key = lambda w: ev(spark, w, phonetics.phonetic_key)
    assert key("Chomu") == key("Chaumoo") == key("chaumu")
    keys = [key(p) for p in PLACES]
    assert len(set(keys)) == len(keys)


def test_romanised_words_share_keys(spark):
    rows = values_frame(spark, [("चौमू",), ("जयपुर",), ("भरतपुर",)], "token STRING")
    got = {r.token: r.key for r in phonetics.romanise_tokens(rows).collect()}
    key = lambda w: ev(spark, w, phonetics.phonetic_key)
    assert got["चौमू"] == key("Chomu") and got["जयपुर"] == key("Jaipur") and got["भरतपुर"] == key("Bharatpur")


def test_spelling_variants(spark):
    assert ev(spark, "Ujjain", phonetics.spelling_variants)[0] == "Ujjain"
    assert all(v.startswith("U") for v in ev(spark, "Ujjain", phonetics.spelling_variants))
    assert ev(spark, "New Town", phonetics.spelling_variants) == ["New Town"]
    assert len(ev(spark, "Veeruphool", phonetics.spelling_variants)) == 3


@pytest.mark.parametrize(
    "sentence,n", [("Three killed on road", 3), ("12 people dead", 12), ("killed two persons", 2), ("bus with 40 seats", None), ("3 injured", None)]
)
def test_counts(spark, sentence, n):
    assert ev(spark, sentence, counts.first_count) == n


def test_names_places_orgs(spark):
    assert ev(spark, "Mr Anil Kumar Rao (late), x", text.clean_name) == "Anil Kumar Rao"
    assert ev(spark, "self", text.clean_name) == ""
    assert ev(spark, "Ujjain-Indore highway, near Khajuri Runda", text.split_location) == [
        "Ujjain-Indore highway", "Ujjain-Indore", "Ujjain", "Indore", "Khajuri Runda", "Khajuri", "Runda",
    ]
    places = lambda v: ev(spark, v, text.split_location)
    assert places("Ujjain – Indore") == ["Ujjain-Indore", "Ujjain", "Indore"]
    assert places("Shop 12, in front of St. John's Church/Village Khed") == ["Shop", "St John s Church", "Church", "Khed"]
    assert places("in Sikar Opposite NEAR Town hall; 400 001") == ["in Sikar", "Sikar", "Town hall"]
    assert places("near, dist. 12") == places("n/a") == places("") == places(None) == []
    assert ev(spark, "the driver Anil Rao was hurt", anchors.extract_names) == ["Anil Rao"]
    assert ev(spark, "Anil Rao", anchors.solo_name) == "Anil Rao"
    assert ev(spark, "Gupta Roadways Pvt", anchors.extract_orgs) == ["Gupta Roadways"]
    assert ev(spark, "on NH-48 at Yamuna Expressway", anchors.extract_corridors) == ["NH-48", "Yamuna Expressway"]


def test_place_scores(spark):
    docs = values_frame(spark, [(1, "A Tata dumper fell near Chomu Toll and driver Anil Rao fled to Sikar")], "id INT, t STRING")
    got = {r.place: r.score for r in anchors.extract_places(docs, "id", "t").collect()}
    assert got["Chomu Toll"] > got.get("Sikar", 0) - 10 and "Tata" not in got and "Anil Rao" not in got


def test_urls(spark):
    f = lambda u, fn: ev(spark, u, fn)
    assert f("https://www.A.example/x/amp/?utm_source=f&q=1#top", urls.canonical_url) == "a.example/x?q=1"
    assert f("not a url", urls.host_of) == ""
    assert f("https://m.bbc.co.uk/x", lambda c: urls.tier_score(urls.host_of(c))) == 24
    assert f("https://notbbc.com/x", lambda c: urls.tier_score(urls.host_of(c))) == 12
    assert f("https://x.example/explore/abc", urls.is_index_page) is True
    assert f("https://x.example/a/b", urls.is_index_page) is False


def test_html(spark):
    body = "word " * 40
    page = f"<html><head><title>Crash &amp; fire - Daily</title><script>x</script></head><body><nav>menu</nav><article><p>{body}</p></article><footer>f</footer></body></html>"
    assert ev(spark, page, html.html_to_text) == body.strip()
    assert ev(spark, page, html.html_title) == "Crash & fire"
    assert ev(spark, "<p>short</p>", html.html_to_text) is None


def test_grams(spark):
    assert ev(spark, "One two three four", text.shingles) == ["one two three", "two three four"]
    assert ev(spark, "One two", text.shingles) == ["one two"]
    assert ev(spark, "ab!c d", text.trigrams) == ["abc", "bcd"]
    assert ev(spark, "", text.trigrams) == []


def test_values(spark):
    clean = lambda v: ev(spark, v, text.clean_value)
    assert clean(" : - Ram\n  Lal |") == "Ram Lal" and clean("x") == "x" and clean("A:B") == "A:B"
    assert {clean(v) for v in ("", " :-| ", "N/A", "Not  Available", "..", "___", "-- nil --", None)} == {None}
    fit = lambda f, v: ev(spark, v, lambda c: text.value_fit(F.lit(f), c))
    assert fit("driver_contact_no", "+91 98765-43210") == 1.0 and fit("driver_contact_no", "12345 67890") == 0.0
    assert fit("driver_contact_no", "98765 4321") == 0.0 and fit("policy_information", "7" * 41) == 0.0
    assert fit("fir_date", "on 3 March, 2021") == 1.0 and fit("fir_date", "2021-3") == 0.0
    assert fit("driver_licence_no", "KA-01 20110012345") == 1.0 and fit("driver_licence_no", "lost") == 0.6
    assert fit("fir_time", "9.30 am") == 1.0 and fit("some_field", "") == 1.0
