"""Features of text lines, for the models that judge lines and passages.

Lines are what "\\n" separates. Lines without a word are left out; a text without any has one empty line, so
that every text has at least one.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
FEATURES = [
    "symbols", "pipes", "marks", "upper", "digits", "other", "repeats", "again", "short", "long_words", "no_end",
    "log_words",
]
_CLASSES = 7


def _class_table() -> np.ndarray:
    """Class of each code point below 65,536: letter, upper-case, digit, symbol, pipe, stop mark, other."""
    kind = np.full(1 << 16, 0, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isupper():
            kind[c] = 1
        elif ch.isdigit():
            kind[c] = 2
        elif ch == "|":
            kind[c] = 4
        elif ch in SYMBOLS:
            kind[c] = 3
        elif ch in "!?":
            kind[c] = 5
        elif not (ch.isalpha() or ch.isspace() or ch in ".,;:'\"()-"):
            kind[c] = 6
    return kind


class LineReader:
    """Turns texts into line features; holds the table of character classes."""

    def __init__(self) -> None:
        self.kind = _class_table()

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features (lines x features), words per line and the first line of each text."""
        lines, starts, words, unique, again, longest = [], [], [], [], [], []
        for text in texts:
            starts.append(len(lines))
            seen: set[str] = set()
            for line in (text or "").split("\n"):
                parts = line.split()
                if not parts:
                    continue
                lines.append(line)
                words.append(len(parts))
                unique.append(len(set(parts)))
                longest.append(len(line))
                again.append(line in seen)
                seen.add(line)
            if len(lines) == starts[-1]:
                lines.append(" ")
                words.append(0)
                unique.append(0)
                longest.append(1)
                again.append(False)
        n = len(lines)
        if not n:
            return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.array(longest, np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kind[np.minimum(codes, 0xFFFF)]
        counts = np.stack([np.add.reduceat(kinds == k, first, dtype=np.int64) for k in range(1, _CLASSES)], axis=1)
        w = np.array(words, np.float64)
        last = kinds[first + size - 1]
        some = np.maximum(w, 1)
        share = counts / size[:, None]
        # Marks of decoration come about one a word, so they are counted by words.
        f = np.stack([
            np.minimum(counts[:, 2] / some, 2), np.minimum(counts[:, 3] / some, 2), np.minimum(counts[:, 4] / some, 2),
            share[:, 0], share[:, 1], share[:, 5], 1 - np.array(unique) / some, np.array(again, np.float64),
            (w < 4).astype(np.float64), np.minimum(size / some / 20, 2),
            (codes[first + size - 1] != ord(".")) & (last != 5), np.log1p(w) / 5,
        ], axis=1).astype(np.float32)
        f[w == 0] = 0
        f[w == 0, 8] = 1
        return f, w.astype(np.int64), np.array(starts, np.int64)


def in_pieces(texts: list[str], chars: int = 2_000_000):
    """Runs of texts of about ``chars`` characters, so that memory follows the longest text, not the batch."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def labelled_lines(docs, labels, per_class: int = 1000, id: str = "doc_id", text: str = "text", most_lines: int = 2000):
    """A bounded sample of labelled texts as line features, for fitting: (features, firsts, label of each text).

    At most ``per_class`` texts of each quality are drawn, in the order of a hash of their ids, and only where
    crc32(id) mod 4 is not 2. Texts of more than ``most_lines`` lines are no part of the sample, and of several texts of
    an id the first in order is: the driver gets a few numbers for each of 2 * per_class * most_lines lines at most.
    Features are made by Spark tasks.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    marks = labels.where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
    drawn = None
    for q in (0, 1):
        some = marks.where(F.col("_quality") == q).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        drawn = some if drawn is None else drawn.union(some)
    picked = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id")
    short = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) < most_lines
    picked = picked.where(short | F.col("_text").isNull()).groupBy("_id", "_quality").agg(F.min("_text").alias("_text"))

    def featured(batches):
        reader = LineReader()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            got = [reader.read([t])[0].tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("_id")), batch.column(batch.schema.get_field_index("_quality")),
                 pa.array(got, pa.binary())], names=["id", "quality", "lines"])

    rows = picked.select("_id", "_quality", "_text").mapInArrow(
        featured, f"id {picked.schema['_id'].dataType.simpleString()}, quality int, lines binary"
    ).collect()
    rows.sort(key=lambda r: (str(r.id), bytes(r.lines)))
    parts = [np.frombuffer(bytes(r.lines), np.float32).reshape(-1, len(FEATURES)) for r in rows]
    firsts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)[: len(parts)]
    features = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)
    return features.astype(np.float64), firsts, np.array([r.quality for r in rows], np.float64)


def labelled_runs(docs, labels, id: str = "doc_id", text: str = "text", most_lines: int = 100):
    """Every labelled text as runs of at most ``most_lines`` lines: (id, quality, at, n, lines), ``lines`` being features.

    Texts whose crc32(id) mod 4 is 2 are left out; a text of more lines stands as several runs, numbered by ``at``, so
    none is too long to learn from. A text that stands in several rows is learnt from in each.

    Labels are never broadcast, so what is shuffled grows in proportion to the texts whatever their number; texts are
    not sorted for the join.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    marks = labels.where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
    picked = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")).join(marks.hint("shuffle_hash"), "_id")

    def featured(batches):
        reader = LineReader()
        for batch in batches:
            ids, marked, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_quality", "_text"))
            for k, t in enumerate(texts):
                found = reader.read([t.as_py()])[0]
                cuts = range(0, len(found), most_lines)
                n = len(cuts)
                parts = [found[a : a + most_lines] for a in cuts]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(k, 1).take(pa.array([0] * n)), marked.slice(k, 1).take(pa.array([0] * n)), pa.array(range(n), pa.int32()),
                     pa.array([len(x) for x in parts], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())],
                    names=["id", "quality", "at", "n", "lines"])

    kind = picked.schema["_id"].dataType.simpleString()
    return picked.select("_id", "_quality", "_text").mapInArrow(featured, f"id {kind}, quality int, at int, n int, lines binary")


def held_out(id):
    """True where crc32 of the id as text leaves 2 when divided by 4: such rows are never learnt from."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
