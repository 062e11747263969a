"""Cases of the third round's findings, on small invented rows."""

import os
import shutil

import duckdb
from harness import SMALL, TABLES, compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry


def _folder(tmp_path, **changed):
    """The small tables, with those of ``changed`` written from SQL over the small ones."""
    for t in TABLES:
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
        os.chmod(tmp_path / f"{t}.parquet", 0o644)
    for t, sql in changed.items():
        duckdb.sql(f"COPY ({sql.format(src=f'{SMALL}/{t}.parquet')}) TO '{tmp_path}/{t}.parquet'")
    return str(tmp_path)


def _agrees(spark, folder, name):
    return compare(entry.queries()[name](spark, folder), duck(folder), entry.oracle_sql()[name])


def test_conflicts_ignore_counts_of_the_prose_and_keep_rows_without_a_claim(spark, tmp_path):
    folder = _folder(tmp_path, documents="""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN text || ' 2 dead and 7 killed, 3' ELSE text END AS text,
        lang, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source, n_chars FROM '{src}'""")
    assert _agrees(spark, folder, "flt12_drop_conflicts") is None


def test_range_pairs_are_not_made_day_by_day(spark):
    # One day, one claim and one piece for each amount: a join by the window alone would make 9,000,000 pairs.
    from corrobora.operators.joins import match_range

    n = spark.range(3000).select("id", (F.col("id") * 25.0 - 40000.0).alias("x"), F.lit("2024-01-02").cast("date").alias("day"))
    claims = n.select(F.col("id").alias("claim_id"), F.col("x").alias("amount"), F.col("day").alias("loss_date"))
    pieces = n.select(F.col("id").alias("piece"), (F.col("x") + 24.0).alias("price"), F.col("day").alias("publish_day"))
    got = match_range(claims, pieces, 1, 2, near=("amount", "price", 50.0))
    # x[j] + 24 - x[i] = 25 (j - i) + 24, below 50 for j - i from -2 to 1.
    assert sorted((r.claim_id, r.piece) for r in got.collect()) == sorted((i, i + k) for i in range(3000) for k in (-2, -1, 0, 1) if 0 <= i + k < 3000)
    assert "_band" in got._jdf.queryExecution().optimizedPlan().toString()


def _counted(spark, rows, schema):
    """Rows that tell how often they are read."""
    reads = spark.sparkContext.accumulator(0)

    def seen(word):
        reads.add(1)
        return word

    word = F.udf(seen, "string").asNondeterministic()
    names = [x.split()[0] for x in schema.split(", ")]
    df = spark.createDataFrame(rows, schema).repartition(2)
    return df.select(*names[:-1], word(names[-1]).alias(names[-1])), reads


def test_words_that_sound_alike_are_counted_by_key_and_articles_read_twice(spark):
    from corrobora.functions.phonetics import latin_words
    from corrobora.operators.joins import count_phonetic

    words = ["ahmad", "ahmed", "kharadi", "karadi", "जयपुर", "jaypur", "été", "road"]
    docs, reads = _counted(spark, [(a, words[(a * 3 + i) % 8]) for a in range(40) for i in range(3)], "article_id long, word string")
    items = spark.createDataFrame([(c, words[(c + i) % 8]) for c in range(8) for i in range(4)], "claim_id long, value string")
    keyed = lambda df, w: latin_words(df, w).select(F.col("token").alias(w), "key")
    got = {(r.claim_id, r.article_id): r.n_values for r in count_phonetic(items.join(keyed(items, "value"), "value"), docs, keys=keyed(docs, "word")).collect()}
    key = {r.value: r.key for r in keyed(items, "value").collect()}
    want = {}
    for c in range(8):
        for a in range(40):
            heard = {key[words[(a * 3 + i) % 8]] for i in range(3)}
            n = sum(len(key[v]) >= 4 and key[v] in heard for v in {words[(c + i) % 8] for i in range(4)})
            want |= {(c, a): n} if n else {}
    assert got == want and any(n > 1 for n in want.values())
    assert reads.value <= 2 * 120


def test_spelled_terms_read_the_articles_twice(spark):
    from corrobora.operators.spelling import spelled_terms

    docs, reads = _counted(spark, [(a, f"kharadivan{a % 7}x") for a in range(60)], "article_id long, term string")
    wanted = spark.createDataFrame([("kharadivan3x",), ("karadivan4x",)], "term string")
    assert spelled_terms(wanted, docs).count() > 0
    assert reads.value <= 2 * 60


def test_cosine_join_shuffles_no_pairs_and_agrees_with_the_prefix_form(spark, monkeypatch):
    import random

    from corrobora.operators import similarity

    rng = random.Random(3)
    rows = lambda n, key: spark.createDataFrame(
        [(i, f"t{t}", rng.randint(1, 3)) for i in range(n) for t in rng.sample(range(12), 5)], f"{key} long, term string, n long")
    left, right = rows(15, "x").cache(), rows(80, "y").cache()
    got = similarity.cosine_join(left, right, "x", "y", 0.6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "x#" in x and "y#" in x]
    here = {(r.x, r.y): round(r.cosine, 9) for r in got.collect()}
    monkeypatch.setattr(similarity, "SMALL_SIDE_BYTES", 0)
    there = {(r.x, r.y): round(r.cosine, 9) for r in similarity.cosine_join(left, right, "x", "y", 0.6).collect()}
    assert here == there and here


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]


def test_counts_are_read_once_for_a_text(spark):
    from corrobora import constants as K
    from corrobora.functions.counts import first_count

    rows = [("Eight people killed", 8, None), ("injuries to 12 persons", None, 12), ("hurt 0 persons, 3 dead", 3, None), ("killed of five, 7 INJURED", 5, 7), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "t string")
    got = df.select(first_count(F.col("t")).alias("a"), first_count(F.col("t"), K.INJURED_WORDS).alias("b"))
    assert [tuple(r) for r in got.collect()] == [(a, b) for _, a, b in rows]
    # The number after the outcome word was searched for once for each use of its value.
    plan = df.select(first_count(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_top_tokens_shuffle_only_texts_in_several_rows(spark):
    from corrobora.operators import ranking

    texts = ["Bridge bridge BRIDGE truck Kharadi", "", None, "ab abc'd 123 Zebra zebra", "truck truck truck overturned near Wagholi"]
    once = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert not _exchanges(ranking.top_tokens(once, "id", "text", 3))
    twice = spark.createDataFrame([(i % 3 if i != 4 else None, t) for i, t in enumerate(texts)] + [(None, "Wagholi")], "id long, text string")
    for df in (once, twice.where("id IS NOT NULL"), twice):
        got = sorted(ranking.top_tokens(df, "id", "text", 3).collect(), key=repr)
        assert got == sorted(ranking._top_tokens_of_rows(df, "id", "text", 3, None).collect(), key=repr) and got


def test_anchors_of_claims_in_one_row_are_not_shuffled(spark):
    from corrobora.operators import anchors as N

    story = "Accident near Lonavala Ghat on NH-48, truck MH-12-AB-1234 overturned, 3 killed. Driver Ramesh Kumar of Gupta Roadways Pvt. At Wagholi, lonavala."
    rows = [(1, "Anil Kumar", "pune", story), (2, None, None, story.replace("Lonavala", "Khandala")), (3, "", None, ""), (4, "Ramesh Kumar", None, "Driver Ramesh Kumar, Mr. RAMESH Kumar")]
    of = lambda rs: spark.createDataFrame(rs, "claim_id long, insured_name string, state string, narrative string")
    assert not _exchanges(N.claim_anchors(of(rows))) and not _exchanges(N.plan_claims(N.claim_anchors(of(rows)), 9))
    # The same rows, each twice, take the way of claims in several rows: token counts apart, the anchors are the same.
    flat = lambda df: sorted(tuple(r) for r in df.where("kind != 'token'").collect())
    one, two = N.build_anchors(of(rows)), N.build_anchors(of(rows + rows))
    assert flat(one) == flat(two) and {r[1] for r in flat(one)} >= {"place", "plate", "name", "org", "corridor", "count"}
    assert not one.groupBy("claim_id", "kind", F.lower("value")).count().where("count > 1").count()
    some = N.build_anchors(of(rows), kinds=["plate", "token"])
    assert {r.kind for r in some.collect()} == {"plate", "token"}
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, one.where("kind IN ('plate', 'token')").collect()))
    plans = [sorted((r.claim_id, r.tier, r.query, r.pick) for r in df.collect()) for df in (
        N.plan_terms(one, 5), N.plan_claims(N.claim_anchors(of(rows)), 5))]
    assert plans[0] == plans[1] and plans[0]
    counts = {(r.kind, r.n, r.n_claims) for r in N.anchor_counts(N.claim_anchors(of(rows))).collect()}
    assert counts == {tuple(r) for r in one.groupBy("kind").agg(F.count("*"), F.countDistinct("claim_id")).collect()}


def test_title_keys_are_ordered_in_the_row(spark):
    from corrobora.operators import similarity

    rows = spark.createDataFrame([(f"Truck {i % 9} overturned near the bridge of Kharadi {i}",) for i in range(60)] + [("Kharadi bridge",), ("kharadi bridge!",)], "title string")
    got = similarity.similar_titles(rows, rows, "title")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "md5" not in plan.split("Join")[0]
    want = {(a, b) for a in ("Kharadi bridge", "kharadi bridge!") for b in ("Kharadi bridge", "kharadi bridge!")}
    pairs = {(r.a_title, r.b_title) for r in got.collect()}
    assert want <= pairs and {(t, t) for (t,) in rows.collect()} <= pairs


def test_claims_of_one_name_and_place_are_matched_once(spark):
    from corrobora.operators.joins import count_names, match_names

    names = [(i, n, t) for i in range(60) for n in (["ann bee", "cat"] if i % 2 else ["dan"]) for t in n.split()] + [(99, "cat", "cat")]
    names = spark.createDataFrame(names, "claim_id long, name string, term string")
    places = spark.createDataFrame([(i, "rome" if i % 3 else "oslo") for i in range(60)] + [(1, "oslo")], "claim_id long, term string")
    words = ["ann", "bee", "cat", "dan", "rome", "oslo", "the"]
    terms = spark.createDataFrame([(a, w) for a in range(80) for k, w in enumerate(words) if (a * 7 + k * k) % (k + 2) == 0], "article_id long, term string")
    want = match_names(names, terms, places).groupBy("claim_id", "name").agg(F.count("*").alias("n_articles"), F.sum("hits").alias("n_hits"))
    got = count_names(names, terms, places)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) != []


def test_hits_are_counted_where_an_article_stands(spark):
    # One shuffle, of the articles' wanted words by article; pairs stay where they are made and words are made once.
    from corrobora.operators.joins import match_terms

    terms, reads = _counted(spark, [(a, f"w{(a * k) % 11}") for a in range(50) for k in range(1, 5)], "article_id long, word string")
    asked = spark.createDataFrame([(c, f"w{(c + k) % 11}") for c in range(9) for k in range(4)], "claim_id long, term string")
    distinct = {(a, f"w{(a * k) % 11}") for a in range(50) for k in range(1, 5)}
    rows = spark.createDataFrame(sorted(distinct), "article_id long, term string")
    got = {(r.claim_id, r.article_id): r.hits for r in match_terms(asked, rows, 2).collect()}
    want = {(c, a): n for c in range(9) for a in range(50) if (n := sum((a, f"w{(c + k) % 11}") in distinct for k in range(4))) >= 2}
    assert got == want
    match_terms(asked, terms.withColumnRenamed("word", "term"), 3).collect()
    assert reads.value == 200


def test_many_nodes_of_similar_headlines_are_never_paired(spark):
    from corrobora.operators import clustering

    # 2,000 nodes of two similar headlines, all different incidents by their figures: paired they would be millions.
    rows = spark.range(2000).select(
        F.lit("c").alias("claim_id"), F.col("id").alias("article_id"), F.lit(1).alias("score"),
        F.when(F.col("id") % 2 == 0, "a bus falls into the old river gorge near town").otherwise("a bus falls into the old river gorge near town today").alias("title"),
        F.lit(None).cast("date").alias("day"), F.array("id").alias("figures"))
    nodes = clustering.build_nodes(clustering.with_nodes(rows))
    links = clustering.title_links(nodes)
    assert links.count() == 4  # each headline with itself and with the other
    assert clustering.elect_leaders(nodes, links).count() == 2000
    got = clustering.collapse_stories(rows).where("story_id = article_id AND distinct_incident")
    assert got.count() == 2000
