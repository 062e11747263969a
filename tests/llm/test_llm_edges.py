"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: each has a defined result."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corrobora.llm import (
    attention_mil, host_reputation, line_crf, metric_join, pii, pivotal_mix, simhash, suffix_pieces, token_counts, tool_calls,
)
from corrobora.llm.common import components, model_bytes

MODEL = "piece_bpe_32k.model"
LONG = "a1b2 " * 40_000 + "x" * 120_000 + "\n" + "1.2" * 20_000 + "\n" + "7 " * 30_000
TEXTS = [
    (1, None, "s"), (2, "", "s"), (3, " \t\n ", None), (4, LONG, "s"), (5, "same words here again", "t"),
    (5, "same words here again", "t"), (6, "same words here again", None), (None, "no id of its own", "t"), (None, None, None),
    (7, "漢字 😀 ▁ \x00 ok\r\n", "u"), (8, "mail a.b@c.de or (at) +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.1 300.1.1.1.1", "u"),
]
SCHEMA = "doc_id long, text string, source string"
CLASHES = [
    "fingerprint", "component_id", "keeps", "fp", "n", "row", "id", "size", "source_size", "target", "copies", "taken", "hash",
    "score", "verdict", "quality", "pii_base", "pii_spans", "pii_scored", "t", "new", "kept_row", "ids", "e", "host", "copy", "x",
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    return docs.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model():
    return model_bytes(MODEL)


def by_id(df, *columns):
    return sorted([tuple(r) for r in df.select("doc_id", *columns).collect()], key=repr)


def test_simhash(spark, odd, empty):
    got = simhash.near_duplicates(odd, carry=["doc_id", "text"])
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    blank = {r.doc_id: (r.fingerprint, r.component_id) for r in rows if not (r.text or "").strip()}
    assert set(blank.values()) == {("0" * 16, 1)} and set(blank) == {1, 2, 3, None}
    assert [r.component_id for r in rows if r.doc_id in (5, 6)] == [5, 5, 5]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).columns == odd.columns
    full = simhash.near_duplicates(odd)
    assert [c for c in full.columns if c not in odd.columns] == [] and full.first().fp == "mine"


def test_simhash_covers_every_pair(spark):
    """All pairs at four bits meet in a mask, and blocks of any size give the same components."""
    import itertools
    import random

    rnd = random.Random(3)
    masks = simhash.masks(4)
    for _ in range(2000):
        bits = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(m & ((1 << 64) - 1) & bits == 0 for m in masks)
    base = rnd.getrandbits(63)
    prints = sorted({base ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 5))) for _ in range(400)})
    edges = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 4]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for block in (7, 100, 8192):
        assert {tuple(r) for r in components(simhash.links(frame, 4, block)).collect()} == want
    assert max(len(simhash.forest(__import__("numpy").array(prints), 4)), 0) < len(prints)


def test_simhash_links_across_the_highest_bit(spark):
    """Buckets of three and more fingerprints, drawn from all 64 bits, link by the bits that differ."""
    import itertools
    import random

    import numpy as np

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rnd = random.Random(5)
    for bits, linked in (((63, 0), True), ((63, 10, 2, 0), True), ((63, 10, 2, 1, 0), False)):
        base = rnd.getrandbits(64)
        pair = [signed(base), signed(base ^ sum(1 << b for b in bits))]
        assert [tuple(sorted(e)) for e in simhash.forest(np.array(pair), 4)] == ([tuple(sorted(pair))] if linked else [])
    base = rnd.getrandbits(64)
    prints = sorted({signed(base ^ sum(1 << b for b in {rnd.choice((63, 62)), *rnd.sample(range(64), rnd.randint(0, 5))})) for _ in range(400)})
    edges = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    want = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    for block in (7, 8192):
        assert {tuple(r) for r in components(simhash.links(frame, 4, block)).collect()} == want


def test_groups_of_similar_sets(spark, monkeypatch):
    """Chains and crowds of near copies at the edge of 0.8, in buckets cut into blocks of any size, and copies by the hundred."""
    import random

    from corrobora.llm import shingle_groups

    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        for _ in range(rnd.choice([1, 2, 6])):
            for _ in range(rnd.choice([0, 1, 2, 3])):
                base = list(base)
                base[rnd.randrange(len(base))] = word()
            texts.append(" ".join(base))
    crowd = [word() for _ in range(200)]
    for i in range(60):
        one = list(crowd)
        one[i * 3] = word()
        texts.append(" ".join(one))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0].upper().replace("W", "w")) for i in range(200)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One  two"), (2005, "one two three"), (None, "one two")]
    sets = [(i, frozenset(shingle_groups.shingle_set((t or "").encode(), 5).tolist())) for i, t in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                while parent[a] != parent[parent[a]] or parent[b] != parent[parent[b]]:
                    parent[a], parent[b] = parent[parent[a]], parent[parent[b]]
                low, high = sorted((parent[a], parent[b]))
                parent = [low if p == high else p for p in parent]
    want = {}
    for k, (i, _) in enumerate(sets):
        want.setdefault(parent[k], []).append(i)
    want = sorted((min(j for j in g if j is not None) for g in want.values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want
    grouped = shingle_groups.grouped
    monkeypatch.setattr(simhash, "grouped", lambda *a: grouped(*a, block=5))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_rules(odd, empty, no_labels):
    field = line_crf.fit(odd, no_labels)
    got = {(r.doc_id, r.text): r.quality for r in line_crf.judge(odd.select("doc_id", "text"), field).collect()}
    assert all(got[k].base_failed and not got[k].kept and got[k].n_words == 0 for k in ((1, None), (2, ""), (3, " \t\n "), (None, None)))
    assert got[(4, LONG)].n_words == 40_000 + 1 + 1 + 30_000 and got[(4, LONG)].base_failed
    assert line_crf.judge(empty, field).count() == 0
    assert line_crf.viterbi([0.0], [[0, 0], [0, 0]]) == [1]  # ties go to content
    assert line_crf.viterbi([5.0, -0.1, 5.0], [[1, -1], [-1, 1]]) == [1, 1, 1]
    assert line_crf.repeated_words("a b c a b c".split()) == 6 and line_crf.repeated_words("a b c".split()) == 0


def test_viterbi_is_the_best_of_all_paths():
    import itertools
    import random

    rnd = random.Random(2)
    for _ in range(200):
        scores = [rnd.uniform(-3, 3) for _ in range(rnd.randint(1, 8))]
        steps = [[rnd.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        value = lambda p: sum(s for s, x in zip(scores, p) if x) + sum(steps[a][b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(value(p) for p in itertools.product((0, 1), repeat=len(scores)))
        assert abs(value(line_crf.viterbi(scores, steps)) - best) < 1e-9


def test_a_sample_takes_each_id_once_and_no_endless_text(spark):
    from corrobora.llm.quality_lines import labelled_lines

    docs = spark.createDataFrame([(i, f"good line {i}.\nsecond") for i in range(40)] + [(3, "good line 3.\nsecond")] * 50 + [(5, "x\n" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    features, firsts, quality = labelled_lines(docs, labels, per_class=30)
    assert len(features) == 2 * len(firsts) and len(firsts) == len(quality) <= 40
    field = line_crf.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n" * 1000), (4, "x\n" * 100_000)], "doc_id long, text string")
    assert line_crf.judge(odd, field).where("quality.kept").count() == 0


def test_scores(odd, empty, no_labels):
    model = attention_mil.fit(odd, no_labels)
    rows = attention_mil.scored(odd, model).collect()
    assert len(rows) == len(TEXTS) and all(r.score == 0.5 for r in rows)
    assert attention_mil.scored(empty, model).count() == 0


def test_gradients_of_attention():
    """The written-out gradients follow numeric ones: a fit on separable bags separates them."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12))
    firsts = np.arange(0, 600, 6)
    y = rng.integers(0, 2, 100).astype(float)
    x[firsts + 2, 0] += 8 * (y - 0.5)  # one telling passage in six
    p = attention_mil.fit_model(x, firsts, y).forward(x, firsts)["p"]
    assert ((p > 0.5) == (y == 1)).mean() > 0.97


def test_mix(odd, empty):
    got = pivotal_mix.mix(odd, carry=["doc_id", "lang"] if "lang" in odd.columns else ["doc_id"]).collect()
    assert len(got) == len(TEXTS)
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert {r.doc_id for r in got if r.source_size == 4} == {3, 6, None} - {None} | {None}
    mixed = pivotal_mix.mixed(odd)
    assert mixed.columns == odd.columns and mixed.where("trim(text) = ''").count() == 0
    assert pivotal_mix.mixed(empty).count() == 0 and pivotal_mix.mix(empty).count() == 0
    full = pivotal_mix.mix(odd)
    assert len(set(full.columns)) == len(full.columns) and full.first().score == "mine"


def test_mix_of_one_hot_source(spark):
    """Many chunks in one size class: the words taken are the target, but for part of one document."""
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"),
    )
    got = pivotal_mix.mix(docs, chunk=16).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 7 for r in got)


def test_mix_of_many_rows_without_an_id(spark, monkeypatch):
    """Rows that share a draw are dealt over chunks: no group is much larger than a chunk."""
    seen = []
    reduce = pivotal_mix._reduce

    def counted(units, keys, seed, name):
        seen.append(units.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return reduce(units, keys, seed, name)

    monkeypatch.setattr(pivotal_mix, "_reduce", counted)
    docs = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("three words here").alias("text"), F.lit("s").alias("source"))
    # One source is taken whole, so a second one gives fractions.
    docs = docs.unionByName(spark.range(30).select("id", F.repeat(F.lit("w "), 5000).alias("text"), F.lit("t").alias("source")).withColumnRenamed("id", "doc_id"))
    got = pivotal_mix.mix(docs, weights=(1, 3), share=0.8, chunk=256).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert max(seen) <= 2 * 256
    assert all(abs(r.taken - r.target) <= 5000 for r in got)


def test_token_counts(odd, empty, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in TEXTS), key=repr)
    for head in (0, 3, 400_000):
        got = token_counts.count_tokens(odd, model, limit=10, head=head)
        assert by_id(got, "n_bytes", "n_tokens") == want
        assert all(r.over_limit == (r.n_tokens > 10) for r in got.collect())
    assert token_counts.count_tokens(empty, model).count() == 0


def test_piece_ids(odd, empty, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = suffix_pieces.encoded(odd, model, check="ok")
    rows = got.collect()
    assert all(r.ok and r.ids == library.encode(r.text or "") and r.row == "mine" for r in rows) and len(rows) == len(TEXTS)
    back = suffix_pieces.decoded(got.drop("text"), model).collect()
    assert sorted(r.text for r in back) == sorted((t or "").replace("▁", " ") for _, t, _ in TEXTS)
    assert suffix_pieces.encoded(empty, model).count() == 0


def test_piece_ids_of_random_texts(model):
    import random

    rnd = random.Random(5)
    parts = list("abcdeth  \n\t▁éñ漢😀.,!|0129ABC") + ["  ", "     ", "\x00", "the", "ing", "ation", "\u00a0", "ﬁ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += [" " * n + end for n in range(40) for end in ("", "a", "漢")]
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = suffix_pieces.Encoder(suffix_pieces.Vocabulary(model), held=500)
    for at in range(0, len(texts), 300):
        assert encoder.encode(texts[at : at + 300]) == library.encode(texts[at : at + 300], num_threads=1)


def test_personal_data(spark, odd, empty):
    none = pii.Boosted()
    got = {(r.doc_id, r.text): r.pii_base for r in pii.spans_of(odd.select("doc_id", "text"), none).collect()}
    assert all(not got[k] for k in ((1, None), (2, ""), (3, " \t\n "), (None, None)))
    found = [(pii.KINDS[s.kind], TEXTS[10][1][s.start : s.end]) for s in got[(8, TEXTS[10][1])]]
    assert found == [("email", "a.b@c.de"), ("phone", "+1 (555) 123-4567"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1")]
    clean = {r.doc_id: r for r in pii.redacted(odd, none).collect()}
    assert clean[8].text == "mail <EMAIL> or (at) <PHONE>, <CARD>, <IP> 300.1.1.1.1" and clean[8].t == "mine"
    assert clean[1].text is None and clean[2].text == "" and clean[4].text.startswith(LONG[:320_000])
    assert pii.redacted(empty, pii.fit(empty)).count() == 0


def test_personal_data_positions_of_many_spans(spark):
    """Positions stay right past a block of prefix sums, and runs of any length are no trouble."""
    import re

    text = " é ".join(f"{i % 256}.1.2.3" for i in range(500)) + " " + "a." * 30_000 + " x@y." + "z." * 5000 + "9" * 50_000
    frame = spark.createDataFrame([(text,)], "text string")
    spans = pii.spans_of(frame, pii.Boosted()).first().pii_base
    want = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
    assert [(s.start, s.end) for s in spans if s.kind == 1] == want
    emails = [text[s.start : s.end] for s in spans if s.kind == 0]
    assert emails == [m[0] for m in re.finditer(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_personal_data_learns_what_the_base_misses(spark):
    """A card number that a run of digits before it hides from the base pattern is selected."""
    def card(i):
        digits = f"4{i:014d}"
        total = sum(int(c) if k % 2 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(digits))
        return digits + str(-total % 10)

    rows = [(i, f"pay with {card(i * 7919)} now") for i in range(200)]
    rows += [(500 + i, f"order {10**15 + i * 7} shipped, not {card(i * 13)[:-1]}{(int(card(i * 13)[-1]) + 5) % 10} either") for i in range(200)]
    rows += [(1000, f"call +1 (555) 555-9305 {card(424242)} please"), (1001, "nothing but 12 words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.spans_of(docs, model).collect()}
    added = {i: [s for s in r.pii_spans if s not in r.pii_base] for i, r in got.items()}
    assert [got[1000].text[s.start : s.end] for s in added[1000] if s.kind == 2] == [card(424242)]
    assert not any(added[i] for i in added if i != 1000)


def test_cards_beside_other_numbers(spark):
    """A card is a candidate at any group border, and what meets only dropped candidates is selected."""
    card = "4111 1111 1111 1111"
    texts = [f"item 12 {card}", f"call +1 555 123 4567 {card}", f"1234 {card} 5th", f"{card} 77 5500-0000-0000-0004", "12 4111111111111111.",
             f"{card[:-1]}2", "漢 7 " + card, None, "", "7 " * 30_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in docs.select("doc_id", "text", pii.card_windows(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    found = {i: {r.text[w.start : w.end] for w in r.w} for i, r in got.items() if r.text}
    assert all(w.value in found[i] for i, r in got.items() for w in r.w)
    assert all(card in found[i] for i in (0, 1, 2, 3, 6)) and "5500-0000-0000-0004" in found[3] and "4111111111111111" in found[4]
    assert card[:-1] + "2" not in found[5] and not got[7].w and not got[8].w and not found[9]

    lone = docs.where("doc_id < 2")
    spans = {r.doc_id: [(s.start, s.end) for s in r.pii_spans] for r in pii.spans_of(lone, pii.Boosted([(pii.FEATURES.index("luhn"), 0.5, -1.0, 1.0)], [1.0], [None, None, 0.0, None])).collect()}
    assert spans == {i: [(texts[i].index(card), len(texts[i]))] for i in (0, 1)}


def test_selection_is_greedy(spark, monkeypatch):
    """Of a chain a > b > c where b meets both, a and c stay."""
    chain = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(2).alias("kind"), F.lit(e).alias("end"), F.lit(m).alias("digits")) for s, e, m in
                      ((0, 10, 3.0), (5, 15, 2.0), (12, 20, 1.0))])
    monkeypatch.setattr(pii, "candidates", lambda text: chain)
    monkeypatch.setattr(pii.Boosted, "margin", lambda self, c: c["digits"])
    docs = spark.createDataFrame([("no data of a person",)], "text string")
    row = pii.spans_of(docs, pii.Boosted(least=[None, None, 0.0, None])).first()
    assert [(s.start, s.end) for s in row.pii_spans] == [(0, 10), (12, 20)]


def test_urls(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme/here"), (4, "HTTP://A.Example.ORG/en/12?x#y"), (4, "HTTP://A.Example.ORG/en/12?x#y"),
        (5, "x://example.org"), (6, "x://notexample.org/en/1"), (7, "a://b://c/d"), (None, "x://10.0.0.1/q"), (8, "x://org/"), (9, "x:///p"),
    ]
    pages = spark.createDataFrame([(i, u, "mine", "mine") for i, u in urls], "page_id long, url string, rule string, found string")
    rules = [("allow", "org/"), ("block", "example.org/en/1")]
    got = host_reputation.judge(pages, rules)
    rows = sorted([tuple(r) for r in got.select("page_id", "host", "path", "rule").collect()], key=repr)
    assert got.columns == ["page_id", "url", "found", "host", "path", "rule", "verdict"]
    assert rows == sorted([
        (1, "", "", None), (2, "", "", None), (3, "", "", None), *[(4, "a.example.org", "/en/12", "example.org/en/1")] * 2,
        (5, "example.org", "", None), (6, "notexample.org", "/en/1", "org/"), (7, "b:", "//c/d", None),
        (None, "10.0.0.1", "/q", None), (8, "org", "/", "org/"), (9, "", "/p", None),
    ], key=repr)
    assert host_reputation.judge(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in host_reputation.judge(pages, []).collect()} == {"allow"}


def test_bad_hosts_are_blocked(spark):
    """A host whose ruled pages are blocked loses its other pages; its sibling with good outcomes keeps them."""
    rows = [(f"x://bad.a.net/de/{i}",) for i in range(40)] + [(f"x://good.b.net/fr/{i}",) for i in range(40)]
    rows += [("x://bad.a.net/en/1",), ("x://good.b.net/en/1",), ("x://new.c.net/en/1",)]
    pages = spark.createDataFrame(rows, "url string")
    got = host_reputation.judge(pages, [("block", "net/de/"), ("allow", "net/fr/")]).where("rule is null")
    assert {r.host: r.verdict for r in got.collect()} == {"bad.a.net": "block", "good.b.net": "allow", "new.c.net": "allow"}


def test_metric_join(spark):
    nan, inf = float("nan"), float("inf")
    a = [1.0, 0.0, 0.0]
    rows = [
        (1, a), (2, a), (2, a), (3, [2.0, 0.0, 0.0]), (4, [0.9, (1 - 0.81) ** 0.5, 0.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]),
        (8, [nan, 0.0, 1.0]), (9, [inf, 0.0, 0.0]), (10, [1.0, None, 0.0]), (None, [0.0, 0.0, 1.0]), (11, [0.0, 0.0, 1e-300]), (12, [5.0, 5.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted([tuple(r) for r in metric_join.near_duplicates(frame, block=2).collect()], key=repr)
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (4, 4, 1, False)]
    want += [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 12)] + [(None, 1, 11, False), (11, 1, 11, True)]
    assert got == sorted(want, key=repr)
    assert metric_join.near_duplicates(frame.where("false")).count() == 0


@pytest.mark.parametrize("settings", [{}, {"pivots": 1, "block": 40}, {"pivots": 9, "block": 25}, {"pivots": 40, "block": 1000}])
def test_metric_join_of_clusters(spark, settings):
    """Clustered vectors, which the bounds do part, and a crowd of near copies: counts and components are exact."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + 0.12 * rng.normal(size=(15, 8)) for c in centres] + [centres[0] + 1e-3 * rng.normal(size=(60, 8))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(frame, **settings).collect()}
    parent = np.arange(len(x))
    for _ in range(len(x)):
        parent = np.where(near, parent, len(x)).min(axis=1)
    assert got == {i: (near[i].sum() - 1, parent[i]) for i in range(len(x))}


def test_equal_numbers_are_equal_bytes(spark):
    """Numbers go by their value, inside any nesting, and digits inside strings stay."""
    import json

    same = [["1", "1.0", "1e0", "100e-2", "10E-1"], ["100", "1e2", "100.00"], ["0", "-0", "0.000", "0e5"], ["-1.5", "-15e-1", "-1.50"],
            ["12345678901234567890", "1234567890123456789e1"], ["1e300", "10E299"], ["0.000001", "1e-6"]]
    quoted = 'a 1.0 " 2.0 \\ 3e0 \\'
    body = lambda n: '{"q":%s,"n":[%s,{"z":%s}],"i":%s}' % (json.dumps(quoted), n, n, n)
    rows = [("c", g * 100 + i, f"{g}-{i}", "f", body(n), []) for g, ns in enumerate(same) for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "conv_id string, position long, call_id string, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([], "conv_id string, position long, call_id string, content string")
    fields = spark.createDataFrame([("f", "i", "integer", True)], "name string, field string, type string, required boolean")
    got = {}
    for r in tool_calls.link(df, results, fields).collect():
        assert json.loads(r.json)["arguments"]["q"] == quoted
        got.setdefault(r.position // 100, set()).add((r.json.split(',"id"')[0], r.problems))
    assert all(len(v) == 1 for v in got.values())
    wrong = {g for g, v in got.items() if "type:i" in next(iter(v))[1]}
    assert wrong == {3, 5, 6}  # no whole number, or one beyond 38 digits
    broken = spark.createDataFrame([("c", 1, "a", "f", '{"i":1,"i":2}', [])], df.schema)
    one = tool_calls.link(broken, results, fields).first()
    assert one.problems == "not an object" and '"arguments"' not in one.json


@pytest.mark.parametrize("together", [0, 3, 2000])
def test_tool_calls(spark, together):
    calls = [
        ("k", 1, "a", "find", '{"b": 2, "a": "x"}', []), ("k", 2, "a", "find", '{"a": "again"}', None),
        ("k", 3, "b", "find", '{"a": 7, "c": null}', ["a", "gone"]), ("k", 9, "d", "none", "{}", []), ("k", 10, None, "find", "not json", []),
        ("back", 5, "p", "find", '{"a": "1"}', ["q"]), ("back", 9, "q", "find", '{"a": "2"}', []),
        ("ring", 1, "m", "find", "[1]", ["n"]), ("ring", 2, "n", "find", '{"a": "x", "b": 1.5}', ["m"]), (None, 1, "z", "find", '{"a":"z"}', []),
    ]
    results = [
        ("k", 4, "a", "first"), ("k", 5, "a", "second"), ("k", 6, "zz", "lost"), ("back", 1, "q", "early"), ("back", 7, "p", None),
        ("ring", 3, "m", "r"), ("ring", 4, "n", "r"), (None, 2, "z", "ok"),
    ]
    fields = [("find", "a", "string", True), ("find", "b", "integer", False)]
    c = spark.createDataFrame(calls, "conv_id string, position long, call_id string, name string, arguments string, depends array<string>")
    r = spark.createDataFrame(results, "conv_id string, position long, call_id string, content string")
    f = spark.createDataFrame(fields, "name string, field string, type string, required boolean")
    rows = tool_calls.link(c.withColumn("row", F.lit(1)), r.withColumn("status", F.lit("mine")), f, together).collect()
    got = {(x.conv_id, x.position): x for x in rows}
    assert len(rows) == len(calls) + len(results)
    status = {k: x.status for k, x in got.items()}
    assert status == {
        ("k", 1): "linked", ("k", 2): "duplicate", ("k", 3): "unanswered", ("k", 9): "unanswered", ("k", 10): "unanswered",
        ("k", 4): "linked", ("k", 5): "duplicate", ("k", 6): "orphan", ("back", 5): "linked", ("back", 9): "linked",
        ("back", 1): "linked", ("back", 7): "linked", **{("ring", i): "circular" for i in (1, 2, 3, 4)}, (None, 1): "linked", (None, 2): "linked",
    }
    problems = {k[1]: x.problems for k, x in got.items() if k[0] == "k" and x.kind == "call"}
    assert problems == {1: "", 2: "", 3: "type:a,unknown:c", 9: "no schema", 10: "not an object"}
    assert got[("ring", 2)].problems == "type:b" and got[("ring", 1)].problems == "not an object"
    assert got[("k", 1)].json == '{"arguments":{"a":"x","b":2},"id":"a","kind":"call","name":"find","status":"linked"}'
    order = [p for _, p in sorted((x.ordinal, x.position) for x in rows if x.conv_id == "back")]
    assert order == [9, 1, 5, 7]
    # Call b needs the result of a, which is stored after it.
    order = [p for _, p in sorted((x.ordinal, x.position) for x in rows if x.conv_id == "k")]
    assert order.index(1) < order.index(4) < order.index(3)
    assert tool_calls.link(c.where("false"), r.where("false"), f).count() == 0
