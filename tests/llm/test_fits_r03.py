"""Models are fitted on all texts, not on a sample of them."""

import zlib

import numpy as np

from corrobora.llm import line_crf, pii, shingle_groups


def test_long_texts_and_all_shares_are_learnt_from(spark):
    # The only bad text has more lines than a run, and more than one share holds.
    good = [(4 * i, "A sentence of several plain words stands here.\n" * 6) for i in range(40)]
    learnt = next(i for i in range(1, 99, 2) if zlib.crc32(str(i).encode()) % 4 != 2)
    bad = [(learnt, "## | ## | $$ || ##\n" * 2500)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    default = line_crf.default_field()
    for lines in (20_000, 500):
        field = line_crf.fit(docs, labels, share_lines=lines)
        assert not np.allclose(field.emission, default.emission) and field.emission[0] < 0
        again = line_crf.fit(docs.repartition(3), labels, share_lines=lines)
        assert np.allclose(field.emission, again.emission) and np.allclose(field.steps, again.steps)


def test_rare_personal_data_among_many_texts_is_learnt_from(spark):
    def card(i):
        digits = f"4{i:014d}"
        total = sum(int(c) if k % 2 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(digits))
        return digits + str(-total % 10)

    rows = [(i, f"pay with {card(i * 7919)} now") for i in range(30)]
    rows += [(100 + i, f"order {10**15 + i * 7} shipped, not {card(i * 13)[:-1]}{(int(card(i * 13)[-1]) + 5) % 10} either") for i in range(60)]
    rows += [(1000 + i, f"no. {i} of the list") for i in range(20_000)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.least[pii.KINDS.index("card")] is not None


def test_blocks_of_near_copies_give_a_forest_and_lose_no_group(spark):
    rng = np.random.default_rng(3)
    bases = [rng.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(2)]
    sets = {}
    for i in range(120):
        own = bases[i % 2].copy()
        own[rng.permutation(60)[:3]] = rng.integers(0, 2**63, 3, dtype=np.uint64)
        sets[i] = np.unique(own)
    links = {(a, b) for a in sets for b in sets if a < b and shingle_groups.jaccard(sets[a], sets[b]) >= 0.8}
    rows = spark.createDataFrame([(7, i, i) for i in sets], "key long, node long, component long")
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "node long, set binary")

    def groups(edges):
        part = {i: i for i in sets}
        for a, b in edges:
            part = {i: part[a] if p == part[b] else p for i, p in part.items()}
        return sorted(sorted(i for i in part if part[i] == p) for p in set(part.values()))

    for block, most in ((1024, len(sets) - 1), (50, 6 * len(sets))):
        got = {(r.a, r.b) for r in shingle_groups.mixed_links(rows, held, 0.8, block).collect()}
        assert got <= links and groups(got) == groups(links)
        assert len(got) <= most < len(links)
