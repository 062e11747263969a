"""Token counts of texts under a SentencePiece BPE model, without token ids of texts.

A piece never crosses a pre-token: no piece of the vocabulary holds a space mark after another character, nor
a line end. So a text's tokens are the sum of its pre-tokens' tokens. Every distinct pre-token of the corpus
is encoded once. Each text's pre-token frequencies are then joined to these counts and summed: frequent
pre-tokens, a table of at most ``head`` short strings, are looked up in the task that reads the text, all others
by a shuffled join. The result does not depend on where the line between the two falls.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import written

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
LONGEST_HEAD = 64  # bytes of a pre-token in the broadcast table


def tokens_alone(sp: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[int]:
    """Tokens of each pre-token. A line end before it takes the space mark that the library puts at the start."""
    before = len(sp.encode("\n"))
    return [len(x) - before for x in sp.encode(["\n" + w for w in words], num_threads=1)]


def check_model(model: bytes) -> None:
    """Raise unless pre-tokens are independent under the model and texts are encoded as they are."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
        raise ValueError("a piece crosses the end of a pre-token")
    probe = "A  ﬁ Å  b\n c "
    if sum(tokens_alone(sp, pre_tokens(probe))) != len(sp.encode(probe)) or sp.decode(sp.encode(probe)) != probe:
        raise ValueError("the model changes texts before it encodes them")


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def vocabulary(docs: DataFrame, text: str = "text", flush: int = 300_000) -> DataFrame:
    """Distinct pre-tokens of the corpus with their frequency, combined in tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(pre_tokens(t or ""))
                if len(held) >= flush:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "freq"]
        )

    seen = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "piece string, freq long")
    return seen.groupBy("piece").agg(F.sum("freq").alias("freq"))


def with_piece_counts(words: DataFrame, model: bytes) -> DataFrame:
    """``words`` (piece, freq) with the tokens of each pre-token in column ``n``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            n = tokens_alone(sp, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["piece", "freq", "n"])

    return words.mapInArrow(encode, "piece string, freq long, n long")


def count_tokens(
    docs: DataFrame, model: bytes, id: str = "doc_id", text: str = "text", limit: int = 4096, head: int = 400_000
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give a row each, and null ids are kept as they
    are. Other columns of ``docs`` are not carried. An empty table gives an empty table.
    """
    check_model(model)
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    words = written(with_piece_counts(vocabulary(docs), model), "pre-tokens")
    # Frequencies in eighths of octaves: a few hundred rows tell where the head ends.
    step = F.floor(F.log2("freq") * 8)
    short = F.octet_length("piece") <= LONGEST_HEAD
    steps = words.where(short).groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, total = float("inf"), 0
    for row in steps:
        total += row.n
        if total > head:
            break
        least = row.step
    in_head = short & (step >= least)
    known = words.where(in_head).select("piece", "n").toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(known["piece"].to_pylist(), known["n"].to_pylist())))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, hash long, n_bytes long, n_head long, piece string, freq long"

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text with the sum of its frequent pre-tokens, and one per rare pre-token of it."""
        lookup = frequent.value
        arrow = pa.schema([("hash", pa.int64()), ("n_bytes", pa.int64()), ("n_head", pa.int64()),
                           ("piece", pa.string()), ("freq", pa.int64())])

        def batch_of(ids: pa.Array, at: list, rows: list) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *columns], names=["id", *arrow.names])

        for batch in batches:
            at, rows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                t = t or ""
                data = t.encode()
                h = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                known = 0
                for piece, freq in Counter(pre_tokens(t)).items():
                    n = lookup.get(piece)
                    if n is None:
                        at.append(k)
                        rows.append((h, None, None, piece, freq))
                    else:
                        known += n * freq
                # No pre-token has a space mark at its end after another character, so this key meets none.
                at.append(k)
                rows.append((h, len(data), known, f"{h}{SPACE}", 0))
                if len(rows) >= 50_000:
                    yield batch_of(batch.column(0), at, rows)
                    at, rows = [], []
            if rows:
                yield batch_of(batch.column(0), at, rows)

    parts = docs.mapInArrow(frequencies, schema)
    rare = words.where(~in_head).select("piece", "n")
    # Equal rows meet in one group: each brings a text row, and all sums are that many times those of one.
    sums = parts.join(rare, "piece", "left").groupBy("id", "hash").agg(
        F.max("n_bytes").alias("n_bytes"),
        F.count("n_head").alias("copies"),
        (F.sum("n_head") + F.coalesce(F.sum(F.col("freq") * F.col("n")), F.lit(0))).alias("tokens"),
    )
    tokens = F.expr("tokens div copies")
    return sums.select(
        F.col("id").alias(id), "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")
