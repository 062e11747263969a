"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array. Every piece of the vocabulary finds
its occurrences as one range of that array by binary search. The occurrences are the edges of a lattice; sorted by
their end they are relaxed from left to right. What is relaxed is not a cost: byte-pair encoding has exactly one
encoding of each prefix, and its last piece is the one edge that is compatible with the last piece of the prefix
before it. Two pieces are compatible if undoing their merges, last merge first, never meets a pair that the encoder
would have merged across their border earlier. So the ids are those of the library, without its merge queue.

A run of spaces is encoded apart: its pieces all rank after those of words, and rank equal among themselves.
"""

from __future__ import annotations

import gc
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corrobora.llm.quality_lines import in_pieces
from corrobora.llm.token_counts import SPACE, check_model, pre_tokens


def merge(symbols: list[str], rank: dict[str, float]) -> list[str]:
    """Byte-pair encoding as defined: the best-ranked adjacent pair is merged, the first of equals, until none is left."""
    n = len(symbols)
    after, before, parts = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    heap = [(rank[parts[i] + parts[i + 1]], i, parts[i], parts[i + 1]) for i in range(n - 1) if parts[i] + parts[i + 1] in rank]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if parts[i] == left else n
        if j >= n or parts[j] != right or not left:
            continue
        parts[i], parts[j] = left + right, ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and parts[a] + parts[b] in rank:
                heapq.heappush(heap, (rank[parts[a] + parts[b]], a, parts[a], parts[b]))
    return [p for p in parts if p]


class Vocabulary:
    """What encoding needs of a model: pieces by string, merge order, how each piece was merged, and byte pieces."""

    def __init__(self, model: bytes) -> None:
        check_model(model)
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(SPACE * 2 in names[i] and names[i].strip(SPACE) for i in plain):
            raise ValueError("a piece holds several spaces and a word")
        self.bytes_at = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.output = [b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(size)]
        for byte, i in self.bytes_at.items():
            self.output[i] = bytes([byte])
        self.id_of = {names[i]: i for i in plain}
        self.rank = {names[i]: -sp.get_score(i) for i in plain if len(names[i]) > 1}
        words = {name: r for name, r in self.rank.items() if name.strip(SPACE)}
        ranks = [0.0] * size  # single characters come before all merges
        left, right = list(range(size)), list(range(size))
        self.pieces: list[str] = []
        for i in plain:
            name = names[i]
            if len(name) == 1:
                self.pieces.append(name)
            elif name in words:
                ranks[i] = words[name]
                # Its last merge; a piece that merging does not reach is never an edge.
                parts = merge(list(name), {k: v for k, v in self._within(name, words) if k != name})
                if len(parts) == 2:
                    left[i], right[i] = self.id_of[parts[0]], self.id_of[parts[1]]
                    self.pieces.append(name)
        self.pair = {(left[i], right[i]): ranks[i] for i in range(size) if left[i] != i}
        self.left, self.right, self.ranks = left, right, ranks
        self.alphabet = sorted(set("".join(self.pieces)))
        self.longest = max(map(len, self.pieces))

    @staticmethod
    def _within(name: str, words: dict[str, float]) -> Iterable[tuple[str, float]]:
        parts = {name[a:b] for a in range(len(name)) for b in range(a + 2, len(name) + 1)}
        return [(p, words[p]) for p in parts if p in words]


class Encoder:
    """Encodes words of batches; keeps which pairs are compatible and the ids of up to ``held`` words."""

    def __init__(self, v: Vocabulary, held: int = 600_000) -> None:
        self.v, self.held = v, held
        # Code 0 is for what no piece holds; codes sort like characters, two bytes each, high byte first.
        self.code = {ch: i + 1 for i, ch in enumerate(v.alphabet)}
        table = np.zeros(0x110000, np.uint16)
        table[[ord(c) for c in v.alphabet]] = np.arange(1, len(v.alphabet) + 1)
        self.table = table
        self.width = 2 * v.longest
        low = [b"".join(self.code[c].to_bytes(2, "big") for c in p) for p in v.pieces]
        self.low = np.array(low, f"S{self.width}")
        self.high = np.array([x + b"\xff" * (self.width - len(x)) for x in low], f"S{self.width}")
        self.ids = np.array([v.id_of[p] for p in v.pieces], np.int64)
        self.sizes = np.array([len(p) for p in v.pieces], np.int64)
        self.fits: dict[int, bool] = {}
        # Ids of pre-tokens and of parts of words, as 32-bit integers in one string each, ready to be joined.
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.lossy: set[str] = set()  # pre-tokens whose ids do not decode to them
        self.meets = np.zeros((len(v.alphabet) + 1) ** 2, bool)
        for p in v.pieces:
            for x, y in zip(p, p[1:]):
                self.meets[self.code[x] * (len(v.alphabet) + 1) + self.code[y]] = True
        self.runs: dict[int, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a: no earlier merge crosses their border."""
        v = self.v
        limit, equal = float("inf"), True  # pairs below the limit are merged first, or at it where ``equal``
        while True:
            r = v.pair.get((a, b))
            if r is not None and (r < limit or (equal and r == limit)):
                return False
            ra, rb = v.ranks[a], v.ranks[b]
            if ra == 0 and rb == 0:
                return True
            # Undo the later merge. A left piece is merged before an equal one to its right.
            if ra > rb:
                limit, equal, a = ra, False, v.right[a]
            else:
                limit, equal, b = rb, True, v.left[b]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces, as (end, start, id), sorted by end and, from the longest on, by length."""
        at = np.flatnonzero(codes)
        padded = np.concatenate([codes, np.zeros(self.v.longest, np.uint16)]).astype(">u2")
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.v.longest)[at]
        suffixes = np.ascontiguousarray(windows).view(f"S{self.width}").ravel()
        order = self._sorted(codes, at)
        suffixes = suffixes[order]
        first = np.searchsorted(suffixes, self.low, "left")
        counts = np.searchsorted(suffixes, self.high, "right") - first
        total = np.cumsum(counts)
        within = np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)
        start = at[order[np.repeat(first, counts) + within]]
        end = start + np.repeat(self.sizes, counts)
        by_place = np.argsort(end * 64 + (63 - (end - start)))
        return end[by_place], start[by_place], np.repeat(self.ids, counts)[by_place]

    def _sorted(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Order of the suffixes from ``at``, as far as the longest piece reaches."""
        found, dense = np.unique(codes, return_inverse=True)
        bits = max(1, int(len(found)).bit_length())
        per_key = 64 // bits
        dense = np.concatenate([dense.astype(np.uint64) + np.uint64(1), np.zeros(self.v.longest + per_key, np.uint64)])
        keys = []
        for a in range(0, self.v.longest, per_key):
            key = np.zeros(len(at), np.uint64)
            for k in range(a, a + per_key):
                key = key << np.uint64(bits) | dense[at + min(k, self.v.longest + per_key - 1)]
            keys.append(key)
        return np.lexsort(keys[::-1])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each with at most one space, at its start."""
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # One unused place after each word keeps occurrences from running on into the next.
        gaps = np.repeat(np.arange(len(words)), sizes)
        codes = np.zeros(len(points) + len(words), np.uint16)
        places = np.arange(len(points)) + gaps
        codes[places] = self.table[points]
        end, start, ids = self.edges(codes)
        odd = places[codes[places] == 0]
        if len(odd):
            # A character without a piece is an edge of its own, known by its negative code point.
            end = np.concatenate([end, odd + 1])
            start = np.concatenate([start, odd])
            ids = np.concatenate([ids, -1 - points[odd - gaps[np.searchsorted(places, odd)]].astype(np.int64)])
            by_place = np.argsort(end, kind="stable")
            end, start, ids = end[by_place], start[by_place], ids[by_place]
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].tolist()
        last, back = [None] * (len(codes) + 1), [0] * (len(codes) + 1)
        for at in begins:
            last[at] = -1  # anything may start a word
        fits, compatible = self.fits, self.compatible
        for e, s, b in zip(end.tolist(), start.tolist(), ids.tolist()):
            if last[e] is None:
                a = last[s]
                if a >= 0 and b >= 0:
                    key = a << 32 | b
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = compatible(a, b)
                    if not ok:
                        continue
                last[e] = b
                back[e] = s
        out = []
        for at, size in zip(begins, sizes.tolist()):
            found, i = [], at + size
            while i > at:
                found.append(last[i])
                i = back[i]
            found.reverse()
            out.append(found)
        if len(fits) > 4_000_000:
            fits.clear()
        return out

    def _run(self, n: int) -> bytes:
        """Ids of ``n`` spaces."""
        if n not in self.runs:
            spaces = {p: r for p, r in self.v.rank.items() if not p.strip(SPACE)}
            self.runs[n] = _packed([self.v.id_of[p] for p in merge([SPACE] * n, spaces)])
        return self.runs[n]

    def _cut(self, words: list[str]) -> tuple[list[str], list[int]]:
        """Words cut wherever no piece holds the two characters at the cut, so that no merge crosses it.

        Returns the parts of all words, and the first part of each word and of the end.
        """
        joined = "".join(words)
        codes = self.table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.meets[codes[:-1] * (len(self.code) + 1) + codes[1:]]
        cut[begins[begins < len(codes)]] = True
        places = np.flatnonzero(cut)
        ends = [*places[1:].tolist(), len(joined)]
        return [joined[a:b] for a, b in zip(places.tolist(), ends)], np.searchsorted(places, begins).tolist()

    def _learn(self, tokens: Iterable[str]) -> None:
        """Ids of pre-tokens not known yet; parts of words are encoded once each, a quarter of a million characters at a time."""
        known, parts, output = self.known, self.parts, self.v.output
        single = _packed([self.v.id_of[SPACE]])
        missing = [t for t in tokens if t not in known]
        if not missing:
            return
        cores = [t.lstrip(SPACE) for t in missing]
        words = [SPACE + c if c and len(c) < len(t) else c for t, c in zip(missing, cores)]
        pieces, firsts = self._cut(words)
        for group in in_pieces([x for x in dict.fromkeys(pieces) if x not in parts], 250_000):
            for x, ids in zip(group, self.encode_words(group)):
                if min(ids) < 0:
                    ids = list(chain.from_iterable(map(self._ids, ids)))
                parts[x] = _packed(ids)
                if b"".join(map(output.__getitem__, ids)) != x.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                    self.lossy.add(x)
        lossy = self.lossy
        for t, c, a, b in zip(missing, cores, firsts, firsts[1:]):
            ids = parts[pieces[a]] if b == a + 1 else b"".join(map(parts.__getitem__, pieces[a:b]))
            spaces = len(t) - len(c)
            if not ids:
                ids = self._run(spaces)
            elif spaces and ids[:4] == single:
                # The space did not join the word, so it belongs to the run.
                ids = self._run(spaces) + ids[4:]
            elif spaces > 1:
                ids = self._run(spaces - 1) + ids
            known[t] = ids
            if lossy and not lossy.isdisjoint(pieces[a:b]):
                lossy.add(t)

    def _ids(self, i: int) -> list[int]:
        return [i] if i >= 0 else [self.v.bytes_at[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]

    def packed(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as 32-bit integers, and whether they decode to it (spaces standing for space marks)."""
        tokens = [pre_tokens(t or "") for t in texts]
        if len(self.known) > self.held:
            self.known = {}
        if len(self.parts) > self.held:
            self.parts, self.lossy = {}, set()
        self._learn(set(chain.from_iterable(tokens)))
        known, lossy = self.known.__getitem__, self.lossy
        # A text's ids and its bytes are those of its pre-tokens one after another, so decoding these is decoding it.
        return [b"".join(map(known, t)) for t in tokens], [not lossy or lossy.isdisjoint(t) for t in tokens]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<i4").tolist() for x in self.packed(texts)[0]]

    def decode(self, ids: Iterable[int]) -> str:
        return decode(self.v.output, ids)


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def decode(output: list[bytes], ids: Iterable[int]) -> str:
    """The text of ids: control pieces are nothing, bytes that are not UTF-8 become the replacement character."""
    data = b"".join(map(output.__getitem__, ids))
    return data[1 if data[:1] == b" " else 0 :].decode("utf-8", "replace")


def encoded(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in array column ``ids``; in ``check``, if named, whether they decode to it.

    Null and empty texts have no ids and decode to the empty text. The space mark of the vocabulary counts as a
    space, so a text that holds it decodes with a space there, which is no failure. Rows are encoded one by one.
    """
    vocabulary = Vocabulary(model)

    @arrow_udf("struct<ids: array<int>, same: boolean>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Ids and words form no circles; looking for some among millions of them would take most of the time.
        gc.disable()
        encoder = Encoder(vocabulary)
        for column in columns:
            found, same = [], []
            for part in in_pieces([t or "" for t in column.to_pylist()], 2_000_000):
                packed, ok = encoder.packed(part)
                found.extend(packed)
                same.extend(ok)
            ends = np.cumsum([0, *map(len, found)]) // 4
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], names=["ids", "same"])
        gc.enable()

    held = docs.select(F.struct(*[c for c in docs.columns if c not in (ids, check)]).alias("row"), encode(F.col(text).cast("string")).alias("e"))
    return held.select("row.*", F.col("e.ids").alias(ids), *([F.col("e.same").alias(check)] if check else []))


def decoded(docs: DataFrame, model: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the text of ``ids`` in column ``text``; null ids give the empty text."""
    output = Vocabulary(model).output

    @arrow_udf("string")
    def back(column: pa.Array) -> pa.Array:
        return pa.array([decode(output, x or []) for x in column.to_pylist()], pa.string())

    return docs.withColumn(text, back(F.col(ids)))
