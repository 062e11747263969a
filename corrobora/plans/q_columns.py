"""Registered queries: text, identifier, date, URL and HTML column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora import defaults
from corrobora.functions import counts as C
from corrobora.functions import dates as D
from corrobora.functions import html as H
from corrobora.functions import identifiers as I
from corrobora.functions import phonetics as P
from corrobora.functions import text as T
from corrobora.functions import urls as U
from corrobora.operators import anchors as A
from corrobora.plans.registry import query
from corrobora.plans.roles import (
    inlist, lst, sql_fold, sql_host, sql_meaningful, sql_phonetic, sql_shingles, sql_spelled_words, sql_title_chars,
    sql_title_words, sql_tokens, sql_trigrams,
)
from corrobora.session import spread
from corrobora.sources.tables import load

# A plate written per customer, valid for three codes of four, in several spellings.
_CODES = ["MH", "UP", "KA", "ZZ"]


def _plate():
    k = F.col("c_custkey")
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (k % 4 + 1).cast("int"))
    num = F.lpad((k % 10000).cast("string"), 4, "0")
    std = F.concat(code, F.lit("-"), k % 99, F.lit(" ab "), num)
    bh = F.concat((k % 90 + 10).cast("string"), F.lit(" BH "), num, F.lit(" A"))
    return F.when(k % 10 == 9, bh).otherwise(std)


_SQL_CODE = "list_extract(['MH', 'UP', 'KA', 'ZZ'], CAST(c_custkey % 4 + 1 AS INT))"
_SQL_NUM = "lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"
_SQL_PLATE = (
    f"CASE WHEN c_custkey % 10 = 9 THEN concat(c_custkey % 90 + 10, 'BH', {_SQL_NUM}, 'A') "
    f"WHEN c_custkey % 4 <> 3 THEN concat({_SQL_CODE}, c_custkey % 99, 'AB', {_SQL_NUM}) END"
)


@query("str1_normalise_plate", f"SELECT c_custkey, {_SQL_PLATE} AS plate FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", I.normalise_plate(_plate()).alias("plate"))


@query(
    "str2_plate_forms",
    f"""SELECT c_custkey, form FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN list_distinct([concat(b, 'BH', n, 'A'), concat(b, ' BH ', n, ' A'), concat(b, '-BH-', n, '-A')])
        ELSE list_distinct([concat(st, k, 'AB', n), concat(st, '-', k2, '-AB-', n), concat(st, ' ', k2, ' AB ', n), concat(st, k2, 'AB ', n), concat(st, ' ', k2, 'AB', n)]) END AS forms
      FROM (SELECT c_custkey, c_custkey % 90 + 10 AS b, {_SQL_NUM} AS n, {_SQL_CODE} AS st, CAST(c_custkey % 99 AS VARCHAR) AS k, lpad(CAST(c_custkey % 99 AS VARCHAR), 2, '0') AS k2
        FROM customer WHERE c_custkey % 10 = 9 OR c_custkey % 4 <> 3)), unnest(forms) AS u(form)""",
)
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.explode(I.plate_forms(_plate())).alias("form"))


@query(
    "str3_extract_codes",
    """SELECT doc_id, code FROM (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(upper(text), '[A-Z0-9][A-Z0-9-]*[A-Z0-9]'),
         lambda t: replace(t, '-', '')), lambda k: length(k) >= 8 AND regexp_matches(k, '[0-9]'))) AS codes FROM documents), unnest(codes) AS u(code)""",
)
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.explode(I.extract_codes(F.col("text"))).alias("code"))


@query("str3_extract_plates", f"SELECT c_custkey, {_SQL_PLATE} AS plate FROM customer WHERE {_SQL_PLATE} IS NOT NULL")
def _(spark, d):
    text = F.concat(F.lit("The vehicle "), F.upper(_plate()), F.lit(", owned by "), F.col("c_name"), F.lit(", was towed."))
    return load(spark, d, "customer").select("c_custkey", F.explode(I.extract_plates(text)).alias("plate"))


@query("str4_redact")
def _(spark, d):
    docs = load(spark, d, "documents")
    clean = docs.select("doc_id", F.col("text"), I.redact_identifiers(F.col("text")).alias("redacted"))
    left = F.col("redacted").rlike(r"[\w.+-]+@[\w.-]+")
    return clean.select("doc_id", F.length("redacted").alias("n_chars"), left.alias("has_email"), F.sha2("redacted", 256).alias("digest"))


@query(
    "str5_native_digits",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS number FROM orders",
)
def _(spark, d):
    native = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "०१२३४५६७८९")
    return load(spark, d, "orders").select("o_orderkey", P.normalise_digits(native).alias("number"))


_NAME_SQL = "CASE c_custkey % 4 WHEN 0 THEN concat('Mr ', c_mktsegment, ' Rao (late)') WHEN 1 THEN concat('Smt K ', lower(c_mktsegment), ' Devi/Owner') WHEN 2 THEN 'Not Registered' ELSE concat(c_name, ', ', c_mktsegment) END"


@query(
    "str6_clean_name",
    f"""SELECT c_custkey, CASE WHEN {sql_meaningful('n')} THEN array_to_string(list_slice(list_filter(string_split(trim(regexp_replace(regexp_replace(
        split_part(split_part(split_part(n, '(', 1), '/', 1), ',', 1), '[^A-Za-z .''-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
        lambda p: length(p) > 1 AND lower(p) NOT IN {inlist(defaults.NAME_NOISE)}), 1, 4), ' ') ELSE '' END AS name FROM (SELECT c_custkey, {_NAME_SQL} AS n FROM customer)""",
)
def _(spark, d):
    k, seg = F.col("c_custkey") % 4, F.col("c_mktsegment")
    raw = (
        F.when(k == 0, F.concat(F.lit("Mr "), seg, F.lit(" Rao (late)"))).when(k == 1, F.concat(F.lit("Smt K "), F.lower(seg), F.lit(" Devi/Owner")))
        .when(k == 2, "Not Registered").otherwise(F.concat("c_name", F.lit(", "), seg))
    )
    return load(spark, d, "customer").select("c_custkey", T.clean_name(raw).alias("name"))


@query(
    "str7_split_location",
    """SELECT p_partkey, place FROM (SELECT p_partkey, list_distinct([a || '-' || b || ' highway', a || '-' || b, a, b] || CASE WHEN TRUE THEN [c || ' ' || t] ELSE [] END
          || list_filter([c, t], lambda x: length(x) >= 5)) AS places
      FROM (SELECT p_partkey, split_part(p_name, ' ', 1) || 'pur' AS a, split_part(p_name, ' ', 2) || 'garh' AS b, split_part(p_name, ' ', 1) AS c, p_type AS t FROM part)), unnest(places) AS u(place)""",
)
def _(spark, d):
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    loc = F.concat(a, F.lit("pur-"), b, F.lit("garh highway, Village "), a, F.lit(" "), "p_type", F.lit(" district"))
    return load(spark, d, "part").select("p_partkey", F.explode(T.split_location(loc)).alias("place"))


_RUN = "[A-Z][a-z]{2,}(?:\\s+[A-Z][a-z]{2,}){0,2}"


@query(
    "str8_place_candidates",
    f"""WITH r AS (SELECT doc_id, string_split_regex(text, '\\b{_RUN}\\b') AS gaps, regexp_extract_all(text, '\\b{_RUN}\\b') AS runs FROM documents),
    e AS (SELECT doc_id, i - 1 AS pos, runs[i] AS run, coalesce(CASE WHEN i > 1 THEN runs[i - 1] END, '') || gaps[i] AS l, coalesce(gaps[i + 1], '') || coalesce(runs[i + 1], '') AS r
      FROM r, unnest(range(1, len(runs) + 1)) AS u(i)),
    c AS (SELECT doc_id, pos, run, lower(run) AS lc, lower(regexp_extract(right(l, 40), '([A-Za-z/]+)[^A-Za-z0-9_]*$', 1)) AS before,
        lower(regexp_extract(left(r, 40), '^[^A-Za-z0-9_]*([A-Za-z]+)', 1)) AS after FROM e)
    SELECT doc_id, pos, run, before, after, 1.0 + CASE WHEN before IN {inlist(defaults.PLACE_CUES)} THEN 3 ELSE 0 END + CASE WHEN after IN {inlist(defaults.PLACE_SUFFIXES)} THEN 2 ELSE 0 END
       + CASE WHEN regexp_matches(lc, '({'|'.join(defaults.PLACE_SUFFIXES)})$') THEN 2 ELSE 0 END + CASE WHEN contains(run, ' ') THEN 1 ELSE 0 END AS score
    FROM c WHERE lc NOT IN {inlist(K.SEARCH_STOPWORDS + defaults.VEHICLE_TYPES + defaults.INCIDENT_TERMS + defaults.PLACE_SUFFIXES + K.ORG_SUFFIXES)}
      AND NOT regexp_matches(lc, '^({'|'.join(defaults.VEHICLE_MAKES)})( |$)') AND NOT regexp_matches(lc, '({'|'.join(defaults.ORG_MARKERS)})')
      AND NOT regexp_matches(lc, '(^|[^a-z0-9_])({'|'.join(defaults.INSTITUTION_WORDS)})($|[^a-z0-9_])') AND before NOT IN {inlist(defaults.NAME_CUES)}""",
)
def _(spark, d):
    runs = load(spark, d, "documents").select("doc_id", F.inline(A.place_candidates(F.col("text"))))
    scored = runs.withColumn("score", A.place_score(F.col("run"), F.col("before"), F.col("after")))
    return scored.where(F.col("score").isNotNull()).withColumn("pos", F.col("pos").cast("bigint"))


@query("str8_places")
def _(spark, d):
    got = A.extract_places(load(spark, d, "documents"), "doc_id", "text")
    return got.select("doc_id", "place", "score", F.col("ordinal.pos").alias("pos"), F.col("ordinal.sub").alias("sub"))


@query("str9_names", "SELECT c_custkey, 'Anil ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS name FROM customer")
def _(spark, d):
    text = F.concat(F.lit("The driver Anil "), F.initcap(F.lower("c_mktsegment")), F.lit(" was hurt, said "), "c_name")
    return load(spark, d, "customer").select("c_custkey", F.explode(A.extract_names(text)).alias("name"))


@query(
    "str10_institutions",
    """SELECT c_custkey, 'lorry of ' || seg || ' Roadways Pvt' AS org, 'NH-' || (c_custkey % 200) AS corridor, seg || ' Police Station' AS police_station, seg || ' Hospital Town' AS hospital
       FROM (SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS seg FROM customer)""",
)
def _(spark, d):
    seg = F.initcap(F.lower("c_mktsegment"))
    text = F.concat(
        F.lit("a lorry of "), seg, F.lit(" Roadways Pvt Ltd. skidded on NH-"), F.col("c_custkey") % 200, F.lit(" and "), seg,
        F.lit(" Police Station took the case. the two went to "), seg, F.lit(" Hospital Town."),
    )
    return load(spark, d, "customer").select(
        "c_custkey", F.get(A.extract_orgs(text), 0).alias("org"), F.get(A.extract_corridors(text), 0).alias("corridor"),
        A.police_station(text).alias("police_station"), A.hospital(text).alias("hospital"),
    )


_VOCAB = [
    ("accident", "en", "accident"), ("the", "en", "article"), ("that", "en", "that"), ("of", "en", "of"),
    ("le", "fr", "article"), ("la", "fr", "article"), ("que", "fr", "that"), ("der", "de", "article"), ("die", "de", "article"),
    ("und", "de", "and"), ("el", "es", "article"), ("los", "es", "article"), ("para", "es", "for"), ("unfall", "de", "accident"),
]


@query(
    "str11_tag_vocabulary",
    f"""WITH v(term, lang, canon) AS (VALUES {', '.join(str(v) for v in _VOCAB)}), t AS (SELECT doc_id, term FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS ws FROM documents), unnest(ws) AS u(term))
    SELECT doc_id, canon, v.lang, count(*) AS n FROM t JOIN v USING (term) GROUP BY ALL""",
)
def _(spark, d):
    from corrobora.session import values_frame

    vocab = values_frame(spark, _VOCAB, "term STRING, lang STRING, canon STRING")
    return A.tag_vocabulary(load(spark, d, "documents"), "doc_id", "text", vocab)


_NUM_CASE = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.NUMBER_WORDS.items()) + " ELSE try_cast(w AS INT) END"


@query(
    "str12_counts",
    f"""SELECT o_orderkey, {_NUM_CASE} AS killed, q AS injured FROM (SELECT o_orderkey, o_orderkey % 20 + 1 AS q,
        list_extract({lst(list(K.NUMBER_WORDS))}, CAST(o_orderkey % 20 + 1 AS INT)) AS w FROM orders)""",
)
def _(spark, d):
    i = (F.col("o_orderkey") % 20 + 1).cast("int")
    word = F.element_at(F.array(*[F.lit(w) for w in K.NUMBER_WORDS]), i)
    text = F.concat(F.lit("On the road "), F.initcap(word), F.lit(" people killed and injuries to "), i, F.lit(" persons."))
    return spread(load(spark, d, "orders"), "o_orderkey").select(
        "o_orderkey", C.first_count(text).alias("killed"), C.first_count(text, K.INJURED_WORDS).alias("injured")
    )


@query("str13_native_places", "SELECT o_orderkey, 'चौमूपुर' AS place, 3 AS score FROM orders UNION ALL SELECT o_orderkey, 'जयपुर', 1 FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, d):
    tail = F.when(F.col("o_orderkey") % 2 == 0, " जयपुर").otherwise("")
    text = F.concat(F.lit("चौमूपुर के पास"), tail, F.lit(" 12 "))
    docs = load(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return A.native_places(docs, "o_orderkey", "t").select("o_orderkey", "place", "score")


def _doc_words(spark, d):
    return load(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()


_DOC_WORDS = "SELECT DISTINCT word FROM (SELECT string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+') AS ws FROM documents), unnest(ws) AS u(word) WHERE word <> ''"
_SPELLED = f"SELECT DISTINCT word, {sql_fold('word')} AS latin FROM ({sql_spelled_words('documents')})"


@query("str14_phonetic_key", f"SELECT word, {sql_phonetic('word')} AS key FROM ({_DOC_WORDS})")
def _(spark, d):
    return _doc_words(spark, d).select("word", P.phonetic_key(F.col("word")).alias("key"))


def _all_doc_words(spark, d):
    """Words of any spelling and script as (token, latin, key)."""
    return P.latin_words(load(spark, d, "documents").select(F.explode(T.spelled_words(F.col("text"))).alias("token")))


@query("str14_phonetic_key_all_words", f"SELECT word, {sql_phonetic('latin')} AS key FROM ({_SPELLED})")
def _(spark, d):
    return _all_doc_words(spark, d).select(F.col("token").alias("word"), "key")


@query("str15_romanise")
def _(spark, d):
    # Words of the documents in Latin letters, written letter by letter in Devanagari, romanised back.
    letters = "कखगघङचछजझञटठडढणतथदधनपफबभमय"
    words = _all_doc_words(spark, d).select(F.regexp_replace("latin", "[^a-z]", "").alias("word")).where("word <> ''")
    native = words.select(F.translate("word", "abcdefghijklmnopqrstuvwxyz", letters).alias("token"))
    return P.romanise_tokens(native)


_SWAP = [("oo", "u"), ("u", "oo"), ("ee", "i"), ("i$", "ee"), ("au", "o"), ("v", "w"), ("w", "v"), ("ck", "k"), ("ph", "f")]
_FORMS = "[word, " + ", ".join(f"left(word, 1) || regexp_replace(substr(word, 2), '{p}', '{r}', 'g')" for p, r in _SWAP) + "]"


def _sql_variants(form: str, rows: str) -> str:
    """Up to three spellings of the column ``form`` of ``rows`` (word, ...), the form itself first."""
    plain = f"length({form}) < 4 OR regexp_matches({form}, '[ऀ-ൿ]')"
    forms = _FORMS.replace("word", form)
    return f"""SELECT word, array_to_string(list_slice(list_transform(list_filter(list_zip(f, range(1, len(f) + 1)), lambda x: list_position(f, x[1]) = x[2]), lambda x: x[1]), 1, 3), ',') AS forms
        FROM (SELECT word, CASE WHEN {form} = '' THEN [] WHEN {plain} THEN [{form}] ELSE list_filter({forms}, lambda v: v = {form} OR length(v) >= 3) END AS f FROM ({rows}))"""


@query("str16_spelling_variants", _sql_variants("word", _DOC_WORDS))
def _(spark, d):
    return _doc_words(spark, d).select("word", F.array_join(P.spelling_variants(F.col("word")), ",").alias("forms"))


@query("str16_spelling_variants_all_words", _sql_variants("latin", _SPELLED))
def _(spark, d):
    forms = F.array_join(P.spelling_variants(F.col("latin")), ",").alias("forms")
    return _all_doc_words(spark, d).select(F.col("token").alias("word"), forms)


@query("str17_tokenize", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest")
    )


@query(
    "str18_shingles",
    f"""SELECT doc_id, len(w) AS n_shingles, len(g) AS n_trigrams, md5(array_to_string(list_sort(w), '|')) AS w_digest, md5(array_to_string(list_sort(g), '|')) AS g_digest
        FROM (SELECT doc_id, {sql_shingles('ws')} AS w, {sql_trigrams('cs')} AS g FROM (SELECT doc_id, {sql_title_words('text')} AS ws, {sql_title_chars("split_part(text, chr(10), 1)")} AS cs FROM documents))""",
)
def _(spark, d):
    docs = load(spark, d, "documents").select(
        "doc_id", T.shingles(F.col("text")).alias("w"), T.trigrams(T.first_line(F.col("text"))).alias("g")
    )
    digest = lambda c: F.md5(F.array_join(F.array_sort(c), "|"))
    return docs.select(
        "doc_id", F.size("w").cast("bigint").alias("n_shingles"), F.size("g").cast("bigint").alias("n_trigrams"),
        digest("w").alias("w_digest"), digest("g").alias("g_digest"),
    )


_FIT_SQL = """CASE f WHEN 'claim_id' THEN CASE WHEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9/\\- ]{4,29}$') THEN 1.0 ELSE 0.0 END
  WHEN 'no_of_occupants' THEN CASE WHEN regexp_matches(v, '^[0-9]{1,3}$') THEN 1.0 ELSE 0.0 END
  WHEN 'fir_date' THEN CASE WHEN regexp_matches(v, '(^|[^0-9A-Za-z_])[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}($|[^0-9A-Za-z_])') THEN 1.0 ELSE 0.0 END
  WHEN 'manufacturing_year' THEN CASE WHEN regexp_matches(v, '^(19|20)[0-9]{2}$') THEN 1.0 ELSE 0.0 END
  WHEN 'vehicle_numbers' THEN CASE WHEN regexp_matches(v, '^MH-[0-9]{4,6}$') THEN 1.0 ELSE 0.0 END ELSE 1.0 END"""
_FIT_FIELDS = ["claim_id", "no_of_occupants", "fir_date", "manufacturing_year", "vehicle_numbers"]


@query(
    "str19_value_fit",
    f"""SELECT o_orderkey, f AS field, v AS value, {_FIT_SQL} AS fit FROM (SELECT o_orderkey, list_extract({lst(_FIT_FIELDS)}, CAST(o_orderkey % 5 + 1 AS INT)) AS f,
        CASE (o_orderkey // 5) % 4 WHEN 0 THEN concat('MH-', o_orderkey % 100000) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 2 THEN CAST(o_orderkey % 300 AS VARCHAR) ELSE CAST(year(o_orderdate) AS VARCHAR) END AS v FROM orders)""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    field = F.element_at(F.array(*[F.lit(f) for f in _FIT_FIELDS]), (k % 5 + 1).cast("int"))
    pick = F.floor(k / 5) % 4
    value = (
        F.when(pick == 0, F.concat(F.lit("MH-"), k % 100000)).when(pick == 1, F.col("o_orderdate").cast("date").cast("string"))
        .when(pick == 2, (k % 300).cast("string")).otherwise(F.year("o_orderdate").cast("string"))
    )
    o = load(spark, d, "orders").select("o_orderkey", field.alias("field"), value.alias("value"))
    return o.withColumn("fit", T.value_fit(F.col("field"), F.col("value")))


_MARK = "|".join(K.PROSE_MARKERS)


@query(
    "str20_prose",
    f"""SELECT doc_id, pos, len(string_split_regex(v, '\\s+')) > 6 OR (len(string_split_regex(v, '\\s+')) >= 3 AND regexp_matches(v, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({_MARK})($|[^\\p{{L}}\\p{{N}}_])'))
        OR regexp_matches(v, '[.;]\\s') OR (regexp_matches(v, '^[a-z]') AND len(string_split_regex(v, '\\s+')) >= 2) AS prose
        FROM (SELECT doc_id, i - 1 AS pos, trim(ls[i]) AS v FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))""",
)
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return docs.select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.looks_like_prose(F.col("line")).alias("prose"))


@query(
    "str21_humanise",
    f"""SELECT key, array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN lower(p[i]) IN {inlist(K.FIELD_ACRONYMS)} THEN upper(p[i]) WHEN lower(p[i]) = 'no' THEN 'No.'
        WHEN i > 1 AND lower(p[i]) IN {inlist(K.FIELD_MINOR_WORDS)} THEN lower(p[i]) ELSE upper(left(p[i], 1)) || substr(p[i], 2) END), ' ') AS heading
        FROM (SELECT key, list_filter(string_split(key, '_'), lambda w: w <> '') AS p FROM (SELECT DISTINCT replace(p_name, ' ', '_of_') || '_no_idv_' || lower(p_type) AS key FROM part))""",
)
def _(spark, d):
    key = F.concat(F.replace("p_name", F.lit(" "), F.lit("_of_")), F.lit("_no_idv_"), F.lower("p_type"))
    return load(spark, d, "part").select(key.alias("key")).distinct().select("key", T.humanise(F.col("key")).alias("heading"))


@query("dt1_flexible_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def _(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    fmt = lambda f: F.date_format(day, f)
    raw = (
        F.when(k % 7 == 0, fmt("yyyy-MM-dd")).when(k % 7 == 1, fmt("dd/MM/yyyy"))
        .when(k % 7 == 2, F.concat(F.lit("Loss on "), fmt("d MMMM yyyy"), F.lit(" at 10"))).when(k % 7 == 3, fmt("MMM d, yyyy"))
        .when(k % 7 == 4, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
        .when(k % 7 == 5, F.when(F.dayofmonth(day) > 12, fmt("MM-dd-yyyy")).otherwise(fmt("dd.MM.yyyy"))).otherwise("n/a")
    )
    return spread(load(spark, d, "orders"), "o_orderkey").select("o_orderkey", D.parse_flexible_date(raw).alias("day"))


@query(
    "dt2_calendar_day",
    "SELECT event_id, CASE WHEN ts >= date_trunc('day', ts) + INTERVAL '23 hours 55 minutes' THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS day FROM events",
)
def _(spark, d):
    return load(spark, d, "events").select("event_id", D.calendar_day(F.col("ts")).alias("day"))


@query(
    "dt3_date_window",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) + i AS day FROM orders, (VALUES (-1), (0), (1), (2)) AS t(i)",
)
def _(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", F.explode(D.date_window(F.col("o_orderdate").cast("date"))).alias("day")
    )


@query(
    "dt4_date_proximity",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o IS NULL THEN 0.5 WHEN NOT contains(t, CAST(year(o) AS VARCHAR)) THEN 0.2
       WHEN s IS NOT NULL THEN CASE WHEN g = 0 THEN 1.0 WHEN g <= 2 THEN 0.9 WHEN g <= 7 THEN 0.7 WHEN g <= 30 THEN 0.4 ELSE 0.1 END
       WHEN contains(lower(t), lower(strftime(o, '%b'))) THEN 0.8 ELSE 0.5 END AS proximity
       FROM (SELECT *, abs(date_diff('day', o, s)) AS g FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o,
         CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS s, strftime(l_shipdate, '%d %b %Y') AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
)
def _(spark, d):
    j = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    claim = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("date"))
    published = F.when(F.col("l_linenumber") != 1, F.col("l_shipdate").cast("date"))
    text = F.date_format("l_shipdate", "dd MMM yyyy")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", D.date_proximity(claim, text, published).alias("proximity"))


_Q = "regexp_extract(url, '\\?([^#]*)', 1)"
_CANON = (
    "lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') || regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), '(?i)/amp$', '') || "
    f"CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END)"
)
_PAGES_KEPT = f"(SELECT *, list_filter(string_split({_Q}, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN {inlist(K.TRACKING_PARAMS)}) AS kept FROM pages)"


@query("url1_canonical", f"SELECT page_id, {_CANON} AS url_key FROM {_PAGES_KEPT}")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url_key"))


@query(
    "url2_publisher",
    f"""SELECT page_id, {sql_host('url')} AS host, CASE WHEN page_id % 3 = 0 THEN concat('outlet', page_id % 5, '.example.org') ELSE {sql_host('url')} END AS publisher FROM pages""",
)
def _(spark, d):
    n = F.col("page_id")
    link = F.when(n % 3 == 0, F.concat(F.lit("https://news.google.com/rss/articles/"), n)).otherwise(F.col("url"))
    reported = F.concat(F.lit("www.Outlet"), n % 5, F.lit(".example.org"))
    return load(spark, d, "pages").select(
        "page_id", U.host_of(F.col("url")).alias("host"), U.publisher(link, reported).alias("publisher")
    )


@query(
    "url3_words",
    "SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || ' ' || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[/\\-_.]+', ' ', 'g'), '\\s+', ' ', 'g')) AS words FROM pages",
)
def _(spark, d):
    return load(spark, d, "pages").select("page_id", U.url_words(F.col("url")).alias("words"))


@query("url4_unwrap", "SELECT page_id, url AS target FROM pages")
def _(spark, d):
    n, url = F.col("page_id"), F.col("url")
    coded = F.translate(F.rtrim(F.replace(F.base64(F.encode(url, "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("=")), "+/", "-_")
    wrapped = (
        F.when(n % 3 == 0, F.concat(F.lit("https://r.example.com/go?x=1&url="), F.url_encode(url), F.lit("&y=2")))
        .when(n % 3 == 1, F.concat(F.lit("https://r.example.com/ck?url=a1"), coded)).otherwise(url)
    )
    return load(spark, d, "pages").select("page_id", U.unwrap_url(wrapped).alias("target"))


_BODY = "html"
for _tag in H.FURNITURE:
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_tag}.*?</{_tag}>', ' ', 'g')"


def _strip_sql(x):
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for p, r in H.ENTITIES:
        r = "''''" if r == "'" else f"'{r}'"
        out = f"regexp_replace({out}, '{p}', {r}, 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(
    "htm1_article_text",
    f"""SELECT page_id, CASE WHEN length(t) >= 120 THEN length(t) END AS n_chars, CASE WHEN length(t) >= 120 THEN md5(t) END AS digest FROM (SELECT page_id, {_strip_sql("CASE WHEN a <> '' THEN a ELSE b END")} AS t
        FROM (SELECT page_id, b, regexp_extract(b, '(?is)<article.*?</article>', 0) AS a FROM (SELECT page_id, {_BODY} AS b FROM pages)))""",
)
def _(spark, d):
    # Some letters are written as character references, decimal or hexadecimal.
    html = F.regexp_replace(F.regexp_replace("html", "tha", "th&#97;"), "ion", "i&#x6f;n")
    text = load(spark, d, "pages").select("page_id", H.html_to_text(html).alias("t"))
    return text.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


def _decode_sql(x):
    for p, r in H.ENTITIES:
        r = "''''" if r == "'" else f"'{r}'"
        x = f"regexp_replace({x}, '{p}', {r}, 'g')"
    return x


@query(
    "htm2_title",
    f"SELECT page_id, trim({_decode_sql(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)' + chr(41))}) AS title FROM pages",
)
def _(spark, d):
    html = F.regexp_replace("html", "</title>", " - Example Daily</title>")
    return load(spark, d, "pages").select("page_id", H.html_title(html).alias("title"))


@query("jsn1_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"t\":\"' || event_type || '\"}' AS packed FROM events")
def _(spark, d):
    p = F.from_json("props", "k INT")
    return load(spark, d, "events").select(
        "event_id", p["k"].alias("k"), F.to_json(F.struct(p["k"].alias("k"), F.col("event_type").alias("t"))).alias("packed")
    )
