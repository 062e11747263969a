"""Phrases by position: the longest wins, native words take endings, and nothing inside a longer phrase counts."""

from corrobora.functions import counts
from corrobora.operators import vocabulary
from corrobora.session import values_frame

VOCABULARY = [
    ("la", "fr", "article"), ("la", "es", "article"), ("de la", "fr", "of the"), ("de la mer", "fr", "of the sea"), ("mer", "fr", "sea"),
    ("दुर्घटना", "hi", "accident"), ("सड़क दुर्घटना", "hi", "road accident"), ("मेर", "hi", "x"), ("  ", "hi", "none"),
]


def test_phrases(spark):
    words = values_frame(spark, VOCABULARY, "term STRING, lang STRING, canon STRING")
    texts = values_frame(
        spark, [(1, "De LA mer, la mer"), (2, "सड़क दुर्घटनाओं में दुर्घटना दुर्घटनाएं"), (3, None), (4, ""), (5, "lamer de"), (6, "de la la")], "k INT, t STRING")
    got = sorted(tuple(r) for r in vocabulary.tag_phrases(texts, "k", "t", words).collect())
    assert got == sorted([
        (1, 0, 3, "de la mer", "fr", "of the sea"), (1, 3, 1, "la", "fr", "article"), (1, 3, 1, "la", "es", "article"), (1, 4, 1, "mer", "fr", "sea"),
        (2, 0, 2, "सड़क दुर्घटना", "hi", "road accident"), (2, 3, 1, "दुर्घटना", "hi", "accident"), (2, 4, 1, "दुर्घटना", "hi", "accident"),
        (6, 0, 2, "de la", "fr", "of the"), (6, 2, 1, "la", "fr", "article"), (6, 2, 1, "la", "es", "article"),
    ])
    assert vocabulary.tag_phrases(texts, "k", "t", words.where("false")).count() == 0


def test_native_counts(spark):
    texts = [("हादसे में तीन लोगों की मौत", 3), ("१२ की मौत", 12), ("एकता की मौत", None), ("मौत", None), ("0 मौत", None), ("दो कार और चार ट्रक वाले लोग मारे गए", 4)]
    df = values_frame(spark, [(i, t) for i, (t, _) in enumerate(texts)], "i INT, t STRING")
    got = {r.i: r.n for r in df.select("i", counts.native_count(df.t).alias("n")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(texts)}
