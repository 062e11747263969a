"""Words of every spelling and script reach a phonetic key."""

import re
import unicodedata
from collections import defaultdict

import pyarrow.parquet as pq
from harness import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corrobora import constants as K
from corrobora.functions import phonetics, text
from corrobora.operators import joins

DOUBLED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


def key_of(word):
    k = "".join(DOUBLED.get(ch, ch) for ch in word.lower())
    k = "".join(ch for ch in unicodedata.normalize("NFKD", k) if not unicodedata.combining(ch))
    for pattern, replacement in K.PHONETIC_RULES:
        k = re.sub(pattern, replacement.replace("$1", r"\1"), k)
    return k


def words_of(s):
    return {w for w in re.split(r"[\W]+", unicodedata.normalize("NFC", (s or "").lower())) if any(ch.isalpha() for ch in w)}


def test_scripts_meet(spark):
    docs = spark.createDataFrame([(1, "Müller"), (2, "राजेश आया"), (3, "Muller"), (4, "rajesh"), (5, "Mu\u0308ller"), (6, None)], "article_id int, text string")
    docs = docs.select("article_id", F.explode(text.spelled_words(F.col("text"))).alias("word"))
    keys = phonetics.latin_words(docs, "word").select(F.col("token").alias("word"), "key")
    anchors = spark.createDataFrame([(1, "muller"), (2, "rajesh")], "claim_id int, value string")
    anchors = anchors.withColumn("key", phonetics.phonetic_key(F.col("value")))
    got = joins.match_phonetic(anchors, docs, keys=keys).select("claim_id", "article_id").distinct().collect()
    assert {tuple(r) for r in got} == {(1, 1), (1, 3), (1, 5), (2, 2), (2, 4)}
    assert phonetics._romanise("\u0905\u093c") == "a"  # a mark that stands alone


def test_queries_by_brute_force(spark):
    read = lambda t, *c: pq.read_table(f"{SMALL}/{t}.parquet", columns=list(c)).to_pylist()
    docs = [(r["doc_id"], words_of(r["text"])) for r in read("documents", "doc_id", "text")]
    items = [(r["item_id"], words_of(r["text"])) for r in read("benchmark", "item_id", "text")]
    key = {w: key_of(w) for _, ws in docs + items for w in ws}
    heard = defaultdict(set)
    for n, ws in docs:
        for w in ws:
            heard[key[w]].add(n)
    want = defaultdict(int)
    for n, ws in items:
        for w in ws:
            for doc in heard[key[w]] if len(key[w]) >= 4 else ():
                want[n, doc] += 1
    queries = entry.queries()
    got = {(r.claim_id, r.article_id): r.n_values for r in queries["jn5_phonetic_all_words"](spark, SMALL).collect()}
    assert got == dict(want)
    keys = {r.word: r.key for r in queries["str14_phonetic_key_all_words"](spark, SMALL).collect()}
    assert keys == {w: key[w] for _, ws in docs for w in ws} and any(not w.isascii() and k for w, k in keys.items())
    assert queries["str16_spelling_variants_all_words"](spark, SMALL).count() == len(keys)
    assert queries["str15_romanise"](spark, SMALL).count() == len({re.sub("[^a-z]", "", k) for k in map(plain, keys)} - {""})


def plain(word):
    return "".join(ch for ch in unicodedata.normalize("NFKD", "".join(DOUBLED.get(c, c) for c in word)) if not unicodedata.combining(ch))
