"""Prefix trie, line ledger and Merkle manifest against plain computations, over odd rows and small blocks."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import line_ledger, merkle, prefix_trie

CLASHES = ["key", "id", "idx", "leaf", "claimed", "row", "body", "version", "tree", "depth", "n_lines", "h", "base", "seq"]


def clashing(df):
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sorted_rows(rows):
    return sorted([tuple(r) for r in rows], key=repr)


# ------------------------------------------------------------------------------------------------ prefix trie

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    said = lambda r, x: sha(f"{len(r.encode())}:{r}{x}")
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t, r or "", x or ""))
    turns = {
        c: [z[1:] for z in sorted(v, key=lambda z: (z[0] is not None, z[0] or 0, said(z[1], z[2])))] for c, v in own.items()
    }
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built = turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        ends[tuple(built)].append(c)
    saved, leaves = defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += n not in children
    return sorted_rows(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]) if n in children else 0, leaves[n], saved[n],
         sha(",".join(map(str, sorted(ends.get(n, []))))))
        for n, m in members.items()
    )


def trie(df):
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(df)))


def test_trie_of_odd_rows(spark, monkeypatch):
    """Nulls everywhere, equal turns, repeated rows, turnless and absent conversations, over blocks of four turns."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rnd = random.Random(3)
    rows = [
        (rnd.choice([None, *range(-7, 14)]), rnd.choice([None, *range(10)]), rnd.choice([None, "", "user", "assistant"]),
         rnd.choice([None, "", "a", "ä", "bb"]))
        for _ in range(400)
    ]
    rows += [(c, t, "user", "x") for c in (21, 22, 23) for t in range(30)] + [(30, 1, "user", "long " * 40_000)]
    df = clashing(spark.createDataFrame(rows, TURNS))
    nodes = trie(df)
    assert sorted_rows(r[:8] for r in nodes.collect()) == plain_trie(rows)
    texts = prefix_trie.with_texts(nodes, df)
    assert texts.where("depth > 0 AND (role IS NULL OR text IS NULL)").count() == 0 and texts.where("depth = 0 AND text IS NOT NULL").count() == 0
    assert texts.where("length(text) > 100000").count() == 1


def test_trie_of_few_rows(spark):
    assert trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
    one = [(1, 1, None, None)]
    assert sorted_rows(r[:8] for r in trie(spark.createDataFrame(one, TURNS)).collect()) == plain_trie(one)


def test_one_conversation_of_most_turns(spark, monkeypatch):
    """Blocks of a long conversation are folded apart, and no window holds more than a block."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    rows = [(10, t, "user", str(t % 7)) for t in range(2000)] + [(c, t, "user", str(t % 7)) for c in (11, 12) for t in range(5)]
    assert sorted_rows(r[:8] for r in trie(spark.createDataFrame(rows, TURNS)).collect()) == plain_trie(rows)


# ------------------------------------------------------------------------------------------------ line ledger

LINES = "doc_id long, text string"


def lowered(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(line_ledger.WHITE))


def plain_lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(lowered(line)) >= 20:
                held[lowered(line)].add(i)
    last = {k: max(s, key=lambda i: (i is not None, i or 0)) for k, s in held.items() if len(s) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if last.get(lowered(x), i) == i]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted_rows(out)


def lines_of(ledger, spark, rows):
    return sorted_rows(line_ledger.deduplicated(ledger, spark.createDataFrame(rows, LINES)).collect())


@pytest.fixture(scope="module")
def line_rows():
    rnd = random.Random(2)
    base = [f"this is a long enough line number {k} ä" for k in range(30)]
    odd = ["", " x ", "short", "\x1c" + "y" * 19]
    line = lambda: rnd.choice(base) if rnd.random() < 0.7 else rnd.choice([*odd, "\t" + rnd.choice(base).upper() + " \r"])
    rows = [(i if i % 9 else None, "\n".join(line() for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    return rows + [(5, None), (5, ""), (7, base[0]), (7, base[0]), (61, "\n".join(base * 300)), (62, base[1] + " " * 50_000)]


def test_lines_come_back_after_deletions(spark, line_rows):
    """Batches, a batch sent twice, deletions, folding of changes and re-insertion: always as if what is left stood alone."""
    ledger, here = line_ledger.EMPTY, []
    for part in (line_rows[:10], line_rows[10:40], line_rows[40:]):
        ledger = line_ledger.insert(ledger, spark.createDataFrame(part, LINES))
        here += part
        assert lines_of(ledger, spark, here) == plain_lines(here)
    ledger = line_ledger.insert(ledger, spark.createDataFrame(line_rows[:10], LINES))
    assert lines_of(ledger, spark, here) == plain_lines(here)
    gone = [None, 5, 62, 61, 59, 58, 57, 50, 1, 2, 3, 999]
    ledger = line_ledger.delete(ledger, spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    left = [r for r in here if r[0] not in gone]
    assert lines_of(ledger, spark, left) == plain_lines(left)
    ledger = line_ledger.compacted(ledger)
    assert len(ledger.refs) == len(ledger.counts) == 1 and lines_of(ledger, spark, left) == plain_lines(left)
    ledger = line_ledger.insert(ledger, spark.createDataFrame([r for r in here if r[0] in gone], LINES))
    assert lines_of(ledger, spark, here) == plain_lines(here)


def test_lines_of_odd_tables(spark, line_rows):
    empty = spark.createDataFrame([], LINES)
    ledger = line_ledger.insert(line_ledger.EMPTY, empty)
    assert line_ledger.deduplicated(ledger, empty).count() == 0
    assert line_ledger.deduplicated(line_ledger.EMPTY, empty).count() == 0
    assert line_ledger.delete(line_ledger.EMPTY, empty) is line_ledger.EMPTY
    docs = clashing(spark.createDataFrame(line_rows, LINES))
    got = line_ledger.deduplicated(line_ledger.insert(line_ledger.EMPTY, docs), docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert sorted_rows(r for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == plain_lines(line_rows)
    assert got.first().body == "mine"


def test_filters_count_copies_and_forget_them():
    rng = np.random.default_rng(1)
    prints, at = line_ledger.places(rng.integers(-(2**63), 2**63 - 1, 5000))
    times = rng.integers(1, 4, 5000)
    slots = np.zeros((line_ledger.BUCKETS, line_ledger.SLOTS), np.uint16)
    stash = line_ledger.add(slots, np.repeat(prints, times), np.repeat(at, times))
    assert len(stash) == 0 and (slots > 0).sum() == times.sum()
    found = line_ledger.copies_of(slots, stash, prints, at)
    assert (found >= times).all() and (found > times).mean() < 0.01
    fresh = line_ledger.copies_of(slots, stash, *line_ledger.places(rng.integers(-(2**63), 2**63 - 1, 5000)))
    assert (fresh > 0).mean() < 0.01
    stash = line_ledger.remove(slots, stash, np.repeat(prints, times - 1), np.repeat(at, times - 1))
    assert (line_ledger.copies_of(slots, stash, prints, at) >= 1).all() and (slots > 0).sum() == 5000


def test_a_full_filter_keeps_what_finds_no_slot():
    slots = np.zeros((4, line_ledger.SLOTS), np.uint16)
    prints, at = line_ledger.places(np.arange(1, 61, dtype=np.int64) * 0x3F7B_1234_5671, 4)
    stash = line_ledger.add(slots, prints, at, rounds=50)
    assert len(stash) == 60 - 16 and (line_ledger.copies_of(slots, stash, prints, at) >= 1).all()
    stash = line_ledger.remove(slots, stash, prints, at)
    assert len(stash) == 0 and not slots.any()


def test_a_key_of_every_document_is_one_row_where_it_is_probed(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a line that every document holds\nx").alias("text"))
    ledger = line_ledger.insert(line_ledger.EMPTY, docs)
    got = line_ledger.deduplicated(ledger, docs).groupBy("n_dropped").count().collect()
    assert {r.n_dropped: r["count"] for r in got} == {1: 2999, 0: 1}
    assert line_ledger.current_counts(ledger).collect()[0].n_docs == 3000 and ledger.shards == 1


# ----------------------------------------------------------------------------------------------------- merkle

DOCS = "doc_id long, text string, source string, lang string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def plain_proofs(rows, fan=16):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[2], r[3], r[4], t))))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[k] = tree([leaf(r, r[1]) for r in groups[k]])
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for p, r in enumerate(groups[k]):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold, siblings = leaf(r, text), []
            for levels, at in ((trees[k], p), (top, g)):
                for level in levels[:-1]:
                    start, i = at // fan * fan, at % fan
                    run = level[start : start + fan]
                    siblings += run[:i] + run[i + 1 :]
                    fold = sha("".join([*run[:i], fold, *run[i + 1 :]]))
                    at //= fan
            out.append((r[0], leaf(r, r[1]), trees[k][-1][0], top[-1][0], sha("".join(siblings)), fold, fold == top[-1][0]))
    return sorted_rows(out)


def proofs(df, **settings):
    return sorted_rows(
        merkle.verify(df, FIELDS, **settings)
        .select("id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", "verified").collect()
    )


@pytest.fixture(scope="module")
def leaf_rows():
    rows = [(None, "A", None, "e", 1), (None, "A", None, "e", 1), (3, None, "x", "e", None), (4, "ABC", "y", None, 1)]
    rows += [(i % 7, "T" * i, "z", "", i) for i in range(40)] + [(100 + i, "Ä B" * (i * 5000), "é", "e", i) for i in range(3)]
    return rows + [(200 + i, f"Text {i}", f"s{i}", "e", i) for i in range(20)]


@pytest.mark.parametrize("settings", [{}, {"runs_a_copy": 1}, {"fan": 2}, {"fan": 3, "runs_a_copy": 2}])
def test_proofs(spark, leaf_rows, settings):
    """Runs of any width, copies of nodes, lone leaves, more groups than a run, nulls, repeated rows and long texts."""
    df = clashing(spark.createDataFrame(leaf_rows, DOCS))
    assert proofs(df, **settings) == plain_proofs(leaf_rows, settings.get("fan", 16))


def test_proofs_of_few_rows(spark, leaf_rows):
    for few in (leaf_rows[:1], leaf_rows[:2], leaf_rows[2:4]):
        assert proofs(spark.createDataFrame(few, DOCS)) == plain_proofs(few)
    assert proofs(spark.createDataFrame([], DOCS)) == []


def test_the_guard_of_recursion_is_put_back(spark, leaf_rows):
    guard = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(guard)
    merkle.verify(spark.createDataFrame(leaf_rows[:3], DOCS), FIELDS)
    assert spark.conf.get(guard) == before
