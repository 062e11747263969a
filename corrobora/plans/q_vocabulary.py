"""Registered queries: phrases of several languages and scripts, and native counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import counts as C
from corrobora.operators import anchors as N
from corrobora.operators import vocabulary as V
from corrobora.plans.q_spelling import _LATIN, _NATIVE, _SYLLABLES
from corrobora.plans.registry import query
from corrobora.plans.roles import CLAIMS_SQL, claims
from corrobora.session import values_frame
from corrobora.sources.tables import load

_PHRASES = [
    ("the", "en", "article"), ("the the", "en", "twice"), ("of the", "en", "of the"), ("de la", "fr", "of the"), ("de la", "es", "of the"),
    ("la", "fr", "article"), ("la de", "es", "that of"), ("de la de", "es", "of that of"), ("que la", "es", "that the"), ("der", "de", "article"),
    ("und der", "de", "and the"), ("die der", "de", "those of"), ("der die", "de", "of those"), ("para", "es", "for"), ("que de", "fr", "that of"),
    ("पारा", "hi", "for"), ("हाहा", "hi", "laughter"), ("हेति", "hi", "weapon"), ("रेहे", "hi", "stay"), ("हेति रेहे", "hi", "stayed armed"),
    ("हेहे de", "hi", "mixed"),
]


def rendered_text(spark, d):
    """Each document as words between blanks, half of them with their syllabic words in Devanagari."""
    docs = load(spark, d, "documents")
    native = lambda w: F.when((F.col("doc_id") % 2 == 1) & w.rlike(_SYLLABLES), F.translate(w, _LATIN, _NATIVE)).otherwise(w)
    return docs.select("doc_id", F.array_join(F.transform(V.phrase_words(F.col("text")), native), " ").alias("text"))


_SPOTS_SQL = f"""ws AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '{_SYLLABLES}') THEN translate(w, '{_LATIN}', '{_NATIVE}') ELSE w END) ELSE ws END AS ws
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w <> '') AS ws FROM documents)),
v AS (SELECT *, string_split(term, ' ') AS vw, len(string_split(term, ' ')) AS n FROM (VALUES {', '.join(str(p) for p in _PHRASES)}) AS t(term, lang, canon)),
tk AS (SELECT doc_id, i - 1 AS pos, ws[i] AS w, ws[i:i + 3] AS nx FROM ws, unnest(range(1, len(ws) + 1)) AS u(i)),
raw AS (SELECT doc_id, pos, n, term, lang, canon FROM tk JOIN v ON nx[1:n - 1] = vw[1:n - 1] AND (nx[n] = vw[n] OR (regexp_matches(vw[n], '[ऀ-ൿ]') AND length(vw[n]) >= 3 AND starts_with(nx[n], vw[n])))),
best AS (SELECT * FROM raw r WHERE NOT EXISTS (SELECT 1 FROM raw o WHERE o.doc_id = r.doc_id AND o.pos <= r.pos AND o.pos + o.n >= r.pos + r.n AND o.n > r.n))"""


@query("str11_phrases", f"WITH {_SPOTS_SQL} SELECT doc_id, canon, lang, count(*) AS n, min(pos) AS first_pos FROM best GROUP BY ALL")
def _(spark, d):
    vocabulary = values_frame(spark, _PHRASES, "term STRING, lang STRING, canon STRING")
    got = V.tag_phrases(rendered_text(spark, d), "doc_id", "text", vocabulary)
    return got.groupBy("doc_id", "canon", "lang").agg(F.count("*").alias("n"), F.min("pos").cast("bigint").alias("first_pos"))


_NUMBERS = ["एक", "दो", "तीन", "चार", "पांच"]


@query(
    "str12_native_counts",
    "SELECT o_orderkey, CAST(o_orderkey % 5 + 1 AS INT) AS killed, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 40 + 1 AS INT) END AS injured FROM orders",
)
def _(spark, d):
    """Counts in Hindi sentences made from the orders: number words and native digits, with words between."""
    n, m = F.col("o_orderkey") % 5, F.col("o_orderkey") % 40 + 1
    word = F.element_at(F.array(*[F.lit(w) for w in _NUMBERS]), (n + 1).cast("int"))
    digits = F.translate(m.cast("string"), "0123456789", "०१२३४५६७८९")
    hurt = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" और "), digits, F.lit(" यात्री घायल हुए"))).otherwise("")
    text = F.concat(F.lit("सड़क हादसे में "), word, F.lit(" लोगों की मौत"), hurt, F.lit("।"))
    return load(spark, d, "orders").select(
        "o_orderkey", C.native_count(text).alias("killed"), C.native_count(text, C.NATIVE_INJURED).alias("injured"))


# Languages of the press by place, for the places of the given tables.
_PLACE_LANGUAGES = [
    ("nation_3", "fr", 1), ("nation_5", "de", 1), ("nation_7", "en", 1), ("nation_7", "fr", 2), ("nation_11", "hi", 1), ("nation_11", "mr", 2),
    ("nation_11", "ta", 3), ("europe", "de", 1), ("europe", "fr", 2), ("america", "es", 1), ("america", "fr", 2), ("asia", "hi", 1), ("africa", "ar", 1),
]


def _placed(spark, d):
    """Claims with their state and region as places."""
    c = claims(spark, d)
    state = c.select("claim_id", F.lit("place").alias("kind"), F.col("state").alias("value"), F.lit(0).alias("ordinal"))
    return state.unionByName(c.select("claim_id", F.lit("place").alias("kind"), F.col("region").alias("value"), F.lit(1).alias("ordinal")))


@query(
    "enr5_place_languages",
    f"""WITH {CLAIMS_SQL}, t(place, language, o) AS (VALUES {', '.join(str(p) for p in _PLACE_LANGUAGES)}),
    p AS (SELECT claim_id, lower(state) AS place, 0 AS pos FROM claims UNION ALL SELECT claim_id, lower(region), 1 FROM claims),
    f AS (SELECT claim_id, language, min((pos, o)) AS first FROM p JOIN t USING (place) GROUP BY ALL)
    SELECT claim_id, 'en' || coalesce(string_agg(CASE WHEN language <> 'en' THEN ',' || language END, '' ORDER BY first, language), '') AS languages FROM f GROUP BY claim_id""",
)
def _(spark, d):
    """Search languages of each claim by its places, English first."""
    table = values_frame(spark, _PLACE_LANGUAGES, "place STRING, language STRING, ordinal INT")
    found = N.place_languages(_placed(spark, d), table)
    none = F.array().cast("array<string>")
    return found.select("claim_id", F.array_join(N.claim_languages(none, F.col("languages"), none), ",").alias("languages"))


@query(
    "enr6_second_anchors",
    f"""WITH {CLAIMS_SQL}, c AS (SELECT claim_id, concat('MH', claim_id % 50 + 1, 'AB', claim_id % 9000 + 1000) AS p1, concat('KA', claim_id % 40 + 1, 'CD', claim_id % 9000 + 1000) AS p2, state, region FROM claims)
    SELECT claim_id, tier, query FROM c, LATERAL (VALUES (1, p1 || ' accident'), (1, p2 || ' accident'), (2, replace(state || ' ' || region, '_', ' ') || ' accident')) AS t(tier, query)""",
)
def _(spark, d):
    """Plans that search for a second plate and a second place as well."""
    n = F.col("claim_id")
    plate = lambda code, of, letters: F.concat(F.lit(code), n % of + 1, F.lit(letters), n % 9000 + 1000)
    c = claims(spark, d)
    of = lambda value, at: c.select("claim_id", F.lit("plate").alias("kind"), value.alias("value"), F.lit(at).alias("ordinal"))
    anchors = of(plate("MH", 50, "AB"), 0).unionByName(of(plate("KA", 40, "CD"), 1)).unionByName(_placed(spark, d))
    templates = {1: ["{plate} accident", "{plate2} accident"], 2: ["{place} {place2} {incident}"]}
    return N.plan_terms(anchors, 9, templates).select("claim_id", "tier", "query")
