"""Operators against brute force on small fixtures."""

import datetime
import random

from pyspark.sql import functions as F

from corrobora.operators import clustering, joins, maintenance, ranking, scoring, similarity
from corrobora.session import values_frame
from corrobora.sources import sinks

DAY = datetime.date(2024, 1, 1)


def grams(title):
    s = "".join(ch for ch in title.lower() if ch.isalnum())
    return {s[i : i + 3] for i in range(len(s) - 2)}


def words3(title):
    w = "".join(ch if ch.isalnum() or ch == " " else " " for ch in title.lower()).split()
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or ({" ".join(w)} if w else set())


def alike(a, b):
    short = len(a.split()) < 6 or len(b.split()) < 6
    x, y = (grams(a), grams(b)) if short else (words3(a), words3(b))
    if not x or not y:
        return False
    return len(x & y) / len(x | y) >= (0.80 if short else 0.72)


def same(a, b):
    if a["day"] and b["day"] and abs((a["day"] - b["day"]).days) > 3:
        return False
    return not a["figs"] or not b["figs"] or bool(set(a["figs"]) & set(b["figs"]))


def greedy(rows):
    lead, flagged = {}, set()
    for claim in {r["claim"] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r["claim"] == claim), key=lambda r: (-r["score"], r["id"])):
            for k in kept:
                if not alike(r["title"], k["title"]):
                    continue
                if not same(r, k):
                    flagged |= {r["id"], k["id"]}
                    continue
                lead[r["id"]] = k["id"]
                break
            else:
                kept.append(r)
                lead[r["id"]] = r["id"]
    return lead, flagged


def test_clustering_equals_the_sequential_rule(spark):
    rng = random.Random(7)
    heads = [
        "Dumper overturns on the old Loni highway killing two", "Dumper overturns on the old Loni highway killing three",
        "Dumper overturns on old Loni road", "Bus falls into gorge", "Bus falls into gorge!", "Truck hits wall near the town market early on Monday",
    ]
    rows = []
    for i in range(160):
        title = rng.choice(heads)
        if rng.random() < 0.2:
            title += " " + rng.choice(["today", "again", "- live"])
        rows.append({
            "claim": f"c{i % 2}", "id": i, "score": rng.randrange(60), "title": title,
            "day": None if rng.random() < 0.2 else DAY + datetime.timedelta(days=rng.randrange(12)),
            "figs": rng.choice([[], [1], [2], [1, 2], [3]]),
        })
    df = spark.createDataFrame(
        [(r["claim"], r["id"], r["score"], r["title"], r["day"], r["figs"]) for r in rows],
        "claim_id STRING, article_id BIGINT, score INT, title STRING, day DATE, figures ARRAY<BIGINT>",
    )
    got = clustering.collapse_stories(df).collect()
    lead, flagged = greedy(rows)
    assert {r.article_id: r.story_id for r in got} == lead
    assert {r.article_id for r in got if r.distinct_incident} == flagged


def test_similar_titles_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = "dumper bus truck falls hits near old loni highway gorge killed two three town road".split()
    make = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randrange(2, 9)))
    a = [make() for _ in range(60)]
    b = [t + rng.choice(["", "", " now", "s"]) for t in a] + [make() for _ in range(60)]
    frame = lambda xs: values_frame(spark, [(x,) for x in xs], "title STRING")
    got = {(r.a_title, r.b_title) for r in similarity.similar_titles(frame(a), frame(b), "title").collect()}
    assert got == {(x, y) for x in set(a) for y in set(b) if alike(x, y)}


def test_match_terms_equals_brute_force(spark):
    rng = random.Random(5)
    terms = {(c, f"t{rng.randrange(12)}") for c in range(8) for _ in range(6)}
    arts = {(a, f"t{rng.randrange(12)}") for a in range(60) for _ in range(5)}
    t = values_frame(spark, sorted(terms), "claim_id INT, term STRING")
    d = values_frame(spark, sorted(arts), "article_id INT, term STRING")
    for need in (1, 2, 3):
        got = {(r.claim_id, r.article_id): r.hits for r in joins.match_terms(t, d, need).collect()}
        want = {}
        for c in range(8):
            for a in range(60):
                n = len({x for k, x in terms if k == c} & {x for k, x in arts if k == a})
                if n >= need:
                    want[c, a] = n
        assert got == want


def test_hash_join_equals_brute_force(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(63) for _ in range(30)]
    hashes = base + [h ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for h in base] + base[:5]
    df = values_frame(spark, [(h,) for h in hashes], "hash64 BIGINT")
    got = {(r.hash_a, r.hash_b): (r.n_a, r.n_b, r.distance) for r in joins.match_hash(df, 3, 6).collect()}
    uniq = sorted(set(hashes))
    want = {
        (a, b): (hashes.count(a), hashes.count(b), bin(a ^ b).count("1"))
        for i, a in enumerate(uniq) for b in uniq[i + 1 :] if bin(a ^ b).count("1") <= 3
    }
    assert got == want


def test_identifier_pairs_and_hits(spark):
    anchors = values_frame(spark, [(c, k) for c in range(5) for k in ("HOT", f"K{c}")], "claim_id INT, key STRING")
    arts = values_frame(spark, [(a, "HOT") for a in range(7)] + [(9, "K3")], "article_id INT, k STRING").select("article_id", F.array("k").alias("keys"))
    assert joins.match_identifiers(anchors, arts).count() == 5 * 7 + 1
    got = {(r.claim_id, r.key): (r.n_articles, r.first_article) for r in joins.identifier_hits(anchors, arts).collect()}
    assert got == {**{(c, "HOT"): (7, 0) for c in range(5)}, (3, "K3"): (1, 9)}


def test_case_detail_chunks_keep_every_child(spark):
    cases = values_frame(spark, [(1,), (2,), (3,)], "k INT")
    kids = spark.range(2500).select(F.when(F.col("id") < 2400, 1).otherwise(2).alias("k"), F.col("id").alias("o"))
    got = joins.case_detail(cases, {"evidence": kids}, "k", "o", chunk=500).collect()
    assert sum(r.n_items or 0 for r in got) == 2500
    assert len([r for r in got if r.k == 1]) == 5 and max(r.n_items for r in got if r.k == 1) < 800
    assert [r.n_items for r in got if r.k == 3] == [None]


def test_distributed_rank_on_one_hot_claim(spark):
    rows = spark.range(3000).select(F.lit("c").alias("claim_id"), F.col("id").alias("article_id"), (F.col("id") * 7 % 50).cast("int").alias("score"))
    got = sinks.evidence_sheet(rows).collect()
    want = sorted(((-r.score, r.article_id) for r in got))
    assert {r.article_id: r.rank for r in got} == {a: i + 1 for i, (_, a) in enumerate(want)}


def test_ranking_twice_changes_nothing(spark):
    rows = values_frame(spark, [("c", i, i % 7, "STRONG" if i % 3 else "CONFIRMED") for i in range(40)], "claim_id STRING, article_id INT, score INT, band STRING")
    one = ranking.rank_evidence(rows, 10)
    two = ranking.rank_evidence(one.drop("rank"), 10)
    assert sorted(one.collect()) == sorted(two.collect())


def interleave(plan, k):
    draw, queues = [1, 1, 2, 3, 4, 1, 2, 3, 4], {}
    for p in plan:
        queues.setdefault(p[0], []).append(p)
    picked, used, cursor, stalled = [], set(), 0, 0
    while len(picked) < k and stalled < len(draw):
        q = queues.get(draw[cursor % 9])
        cursor += 1
        if q:
            i = next((j for j, p in enumerate(q) if p[1] not in used), 0)
            p = q.pop(i)
            used.add(p[1])
            picked.append(p)
            stalled = 0
        else:
            stalled += 1
    return {p[2] for p in picked}


def test_interleaved_topk_equals_the_draw(spark):
    rng = random.Random(2)
    plans = {}
    for c in range(25):
        n = rng.randrange(1, 30)
        plans[c] = [(t := rng.randrange(1, 5), f"{t}-{rng.randrange(3)}", s) for s in range(n)]
    df = values_frame(spark, [(c, *p) for c, ps in plans.items() for p in ps], "c INT, tier INT, cls STRING, seq INT")
    got = {}
    for r in ranking.interleaved_topk(df, "c", 10).collect():
        got.setdefault(r.c, set()).add(r.seq)
    assert got == {c: interleave(ps, 10) for c, ps in plans.items()}


def base_facts(**over):
    row = dict(
        claim_id="c", article_id=1, plate_hit=False, name_hit=False, org_hit=False, place_hits=0, corridor_hits=0, case_incident=False, vehicle_hits=0,
        token_hits=0, incident_hit=False, gap_days=None, date_verbatim=False, domain_score=12, target_count=None, claim_dated=True, social=False, undated=False,
    )
    figures = over.pop("figures", [])
    row.update(over)
    return row, figures


def score(spark, **over):
    row, figures = base_facts(**over)
    ddl = ("claim_id STRING, article_id INT, plate_hit BOOLEAN, name_hit BOOLEAN, org_hit BOOLEAN, place_hits INT, corridor_hits INT, case_incident BOOLEAN, vehicle_hits INT, "
           "token_hits INT, incident_hit BOOLEAN, gap_days INT, date_verbatim BOOLEAN, domain_score INT, target_count INT, claim_dated BOOLEAN, social BOOLEAN, undated BOOLEAN")
    df = values_frame(spark, [tuple(row.values())], ddl).withColumn("figures", F.array(*[F.lit(f) for f in figures]).cast("array<int>"))
    return scoring.score_evidence(df).first()


def test_bands_follow_what_matched(spark):
    assert score(spark, plate_hit=True).band == "CONFIRMED"
    assert score(spark, name_hit=True, social=True).band == "STRONG"
    assert score(spark, name_hit=True, plate_hit=True, social=True).band == "CONFIRMED"
    assert score(spark, place_hits=1, incident_hit=True, gap_days=1).band == "STRONG"
    assert score(spark, place_hits=1, incident_hit=True, gap_days=60).band == "BACKGROUND"
    assert score(spark, place_hits=2, incident_hit=True, claim_dated=False).band == "STRONG"
    assert score(spark, place_hits=1, social=True) is None


def test_scores(spark):
    assert score(spark, plate_hit=True, incident_hit=True, gap_days=1).score == 45 + 10 + 18 + 6
    assert score(spark).score == 0
    assert score(spark, plate_hit=True, name_hit=True, org_hit=True, incident_hit=True, place_hits=3, gap_days=0).score == 100
    agree = score(spark, plate_hit=True, incident_hit=True, target_count=3, figures=[3])
    clash = score(spark, plate_hit=True, incident_hit=True, target_count=3, figures=[2])
    assert agree.score - clash.score == 42


def test_upsert_keeps_workflow_columns(spark):
    old = values_frame(spark, [(1, "a", "done"), (2, "b", "done")], "id INT, name STRING, status STRING")
    new = values_frame(spark, [(2, "B", "queued"), (3, "c", "queued")], "id INT, name STRING, status STRING")
    got = {(r.id, r.name, r.status) for r in maintenance.upsert_cases(old, new, "id", ["name"]).collect()}
    assert got == {(1, "a", "done"), (2, "B", "done"), (3, "c", "queued")}


def test_representative_prefers_the_publisher(spark):
    rows = values_frame(
        spark,
        [("c", 1, 10, "https://news.google.com/x", "long snippet here", DAY.isoformat(), 90), ("c", 1, 11, "https://a.example/x", "s", None, 80)],
        "claim_id STRING, story_id INT, article_id INT, url STRING, snippet STRING, day STRING, score INT",
    ).withColumn("day", F.col("day").cast("date"))
    got = clustering.choose_representative(rows).first()
    assert (got.article_id, got.aggregator_url, got.snippet, got.day) == (11, "https://news.google.com/x", "long snippet here", DAY)
