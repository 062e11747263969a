"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import (
    attention_mil, host_reputation, line_crf, line_ledger, merkle, metric_join, pii, pivotal_mix, prefix_trie, simhash, suffix_pieces,
    token_counts, tool_calls,
)
from corrobora.llm.common import model_bytes, n_words, table
from corrobora.llm.oracles import OP1_SQL, OP5_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from corrobora.llm.quality_lines import held_out
from corrobora.session import values_frame

PIECE_MODEL = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Fields of the two tools that the turns of conversations are read as calls of.
TOOL_FIELDS = [
    ("search", "limit", "integer", True), ("search", "query", "string", True),
    ("summarise", "lines", "integer", True), ("summarise", "query", "string", True), ("summarise", "limit", "integer", False),
]


@query(OP1_SQL)
def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call, every assistant turn as the result of the turn before it.

    A turn of several lines asks for a summary and gives its lines as text, which the fields do not allow; the
    first turn gives no limit. A call needs the result of the call two turns before. Conversations with a system
    turn are taken as logged newest first, so that their stored order runs against the links.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    logged = turns.groupBy("conv_id").agg(F.max(F.col("role") == "system").alias("reverse"))
    turns = turns.join(logged, "conv_id").withColumn("position", F.when(F.col("reverse"), -F.col("turn")).otherwise(F.col("turn")))
    lines = F.size(F.split("text", "\n", -1))
    limit = F.when(F.col("turn") > 0, n_words(F.col("text")))
    several = lines > 1
    search = F.to_json(F.struct(limit.alias("limit"), F.col("text").alias("query")))
    summarise = F.to_json(F.struct(F.col("text").alias("query"), lines.cast("string").alias("lines"), limit.alias("limit")))
    number = lambda back: F.concat(F.lit("call-"), (F.col("turn") - back).cast("string"))
    calls = turns.where("role = 'user'").select(
        "conv_id", "position", number(0).alias("call_id"), F.when(several, "summarise").otherwise("search").alias("name"),
        F.when(several, summarise).otherwise(search).alias("arguments"), F.array(number(2)).alias("depends"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", "position", number(1).alias("call_id"), F.col("text").alias("content"))
    fields = values_frame(spark, TOOL_FIELDS, "name string, field string, type string, required boolean")
    return tool_calls.link(calls, results, fields)


@query()
def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = attention_mil.fit(docs, table(spark, sf_dir, "labels"), per_class=1000)
    return attention_mil.scored(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query()
def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.judge(docs, field).select("doc_id", "quality.*")


@query()
def op4_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, radius=4, width=4, carry=["doc_id"]).drop("keeps")


URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


@query(OP5_SQL)
def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return host_reputation.judge(pages, URL_RULES, least=0.5, z=1.645).drop("url")


@query()
def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pivotal_mix.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0, carry=["doc_id"])


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, model_bytes(PIECE_MODEL), limit=4096)


@query()
def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans_of(docs, pii.fit(docs))
    kinds = F.transform("pii_base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(F.col("pii_base")), 256).alias("base_sha256"),
        pii.listed(F.col("pii_spans")).alias("spans"),
    )


@query()
def op9_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_pieces.encoded(docs, model_bytes(PIECE_MODEL), check="round_trip")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


@query()
def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.9)


@query(OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(turns))).drop("turn_hash")


@query(OP12_SQL)
def op12_line_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = line_ledger.insert(line_ledger.EMPTY, docs)
    return line_ledger.deduplicated(ledger, docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    proofs = merkle.verify(table(spark, sf_dir, "documents").select(*fields), fields)
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified"
    )
