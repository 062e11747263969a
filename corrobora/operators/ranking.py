"""Ranks, top-k, de-duplication by key and diversified selection.

Two rules hold here. A window is only used where the rank is limited, because
Spark then limits every partition before the shuffle. Where one row per group
is wanted, an aggregation is used, because it combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora import defaults
from corrobora.functions.text import SEARCH_TOKEN, grouped, let
from corrobora.session import cut_lineage, split_repeated


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per group, numbered."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def band_rank(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in K.BANDS]), band)


def rank_evidence(df: DataFrame, k: int = K.RANK_LIMIT) -> DataFrame:
    """Evidence per claim by band, then score, then id; the first ``k``."""
    order = [band_rank(F.col("band")).asc(), F.col("score").desc(), F.col("article_id").asc()]
    return top_k(df, ["claim_id"], order, k)


def distributed_rank(
    df: DataFrame, by: list[str], order: list[Column], name: str, limit: int | None = None
) -> DataFrame:
    """Row numbers per group without putting a group into one task.

    Rows are range-partitioned on group and order, numbered inside each
    (group, partition), and shifted by the group's row counts in earlier
    partitions. Only those counts, one per group and partition, are windowed.
    """
    if limit is not None:
        return top_k(df, by, order, limit, name)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("_pid", F.spark_partition_id())
    )
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_pid").orderBy(*order)))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*by, "_pid")
        .agg(F.count("*").alias("_c"))
        .withColumn("_shift", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .drop("_c")
    )
    return (
        local.join(shifts, [*by, "_pid"])
        .withColumn(name, F.col("_n") + F.col("_shift"))
        .drop("_pid", "_n", "_shift")
    )


def dedupe_by_url(df: DataFrame, url_key: str = "url_key") -> DataFrame:
    """Best-scored row per canonical URL, with the longest snippet seen for it."""
    row = F.struct(*[c for c in df.columns if c != "snippet"])
    best = df.groupBy(url_key).agg(
        F.max_by(row, F.struct(F.col("score"), F.col("article_id"))).alias("_r"),
        F.max_by("snippet", F.struct(F.length("snippet"), "snippet")).alias("snippet"),
        F.count("*").alias("n_copies"),
    )
    return best.select("_r.*", "snippet", "n_copies")


def first_seen(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row per key by ordinal."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), ordinal).alias("_r")).select("_r.*")


def interleaved_topk(df: DataFrame, by: str, k: int) -> DataFrame:
    """Plan rows drawn across tiers in the order 1,1,2,3,4,1,2,3,4; unused classes first.

    Input columns: ``tier`` 1-4, ``cls``, ``seq``. At most ``k`` rows of a class
    and ``k`` of a tier can ever be drawn, so both ranks are limited to ``k``.
    Classes are taken to stay within one tier.
    """
    per_class = top_k(df, [by, "tier", "cls"], [F.col("seq").asc()], k, "_c")
    repeat = (F.col("_c") > 1).cast("int")
    per_tier = top_k(per_class, [by, "tier"], [repeat.asc(), F.col("seq").asc()], k, "_t")
    cycle = len(K.TIER_DRAW_ORDER)
    slot = None
    for tier in sorted(set(K.TIER_DRAW_ORDER)):
        offsets = [i for i, t in enumerate(K.TIER_DRAW_ORDER) if t == tier]
        n = F.col("_t") - 1
        place = F.floor(n / len(offsets)) * cycle + F.get(F.array(*[F.lit(o) for o in offsets]), n % len(offsets))
        slot = F.when(F.col("tier") == tier, place) if slot is None else slot.when(F.col("tier") == tier, place)
    drawn = top_k(per_tier.withColumn("slot", slot.cast("int")), [by], [F.col("slot").asc()], k, "pick")
    return drawn.drop("_c", "_t")


def interleaved(rows: Column, k: int) -> Column:
    """:func:`interleaved_topk` of one group, as its array of structs (seq, tier, cls, ...), with ``slot`` and ``pick``.

    Every row is compared with every other one: for bounded lists, such as plan rows made from templates.
    """
    before = lambda rs, r, of: F.size(F.filter(rs, lambda o: of(o, r))) + 1
    cycle = len(K.TIER_DRAW_ORDER)
    with_class = lambda rs: F.transform(rs, lambda r: F.struct(r.alias("r"), before(
        rs, r, lambda o, r: (o["tier"] == r["tier"]) & o["cls"].eqNullSafe(r["cls"]) & (o["seq"] < r["seq"])).alias("c")))
    kept = let(rows, lambda rs: F.filter(with_class(rs), lambda x: x["c"] <= k))

    def ahead(o: Column, x: Column) -> Column:
        late_o, late_x = o["c"] > 1, x["c"] > 1
        earlier = (~late_o & late_x) | ((late_o == late_x) & (o["r"]["seq"] < x["r"]["seq"]))
        return (o["r"]["tier"] == x["r"]["tier"]) & earlier

    def slot(tier: Column, t: Column) -> Column:
        out = None
        for value in sorted(set(K.TIER_DRAW_ORDER)):
            offsets = [i for i, x in enumerate(K.TIER_DRAW_ORDER) if x == value]
            n = t - 1
            place = F.floor(n / len(offsets)) * cycle + F.get(F.array(*[F.lit(o) for o in offsets]), n % len(offsets))
            out = F.when(tier == value, place) if out is None else out.when(tier == value, place)
        return out.cast("int")

    ranked = let(kept, lambda xs: F.transform(xs, lambda x: F.struct(before(xs, x, ahead).alias("t"), x["r"].alias("r"))))
    placed = F.transform(F.filter(ranked, lambda x: x["t"] <= k), lambda x: F.struct(slot(x["r"]["tier"], x["t"]).alias("slot"), x["r"].alias("r")))
    return F.transform(F.slice(F.sort_array(placed), 1, k), lambda x, i: F.struct(x["r"].alias("r"), x["slot"].alias("slot"), (i + 1).alias("pick")))


def spanning_topk(df: DataFrame, by: str, k: int) -> DataFrame:
    """Like :func:`interleaved_topk`, for classes that may stand in several tiers: a class used in one is used in all.

    Input columns: ``tier`` 1-4, ``cls``, ``seq``. A draw takes from its tier the first row of a class not drawn yet,
    else the first row left. A draw of ``k`` rows can only take one of a tier's first ``k`` rows or one of the first
    rows of its first ``k`` classes, so a group's fold is over a bounded list; both ranks are limited to ``k``.
    Returns the rows drawn with ``pick``, their place in the draw.
    """
    cycle = len(K.TIER_DRAW_ORDER)
    leading = top_k(df, [by, "tier", "cls"], [F.col("seq").asc()], 1, "_c").drop("_c")
    kept = top_k(leading, [by, "tier"], [F.col("seq").asc()], k, "_t").unionByName(
        top_k(df, [by, "tier"], [F.col("seq").asc()], k, "_t")
    )
    row = F.struct("seq", "tier", "cls")
    each = kept.groupBy(by).agg(F.array_sort(F.collect_set(row)).alias("rows"))

    def draw(state: Column, i: Column) -> Column:
        tier = F.get(F.array(*[F.lit(t) for t in K.TIER_DRAW_ORDER]), i % cycle)
        left = F.filter(state["left"], lambda r: r["tier"] == tier)
        fresh = F.filter(left, lambda r: ~F.array_contains(state["used"], r["cls"]))
        one = F.coalesce(F.get(fresh, 0), F.get(left, 0))
        drawn = F.when(one.isNotNull() & (F.size(state["drawn"]) < k), F.array(one)).otherwise(F.array_compact(F.array(F.lit(None).cast(one_type))))
        return F.struct(
            F.array_except(state["left"], drawn).alias("left"),
            F.concat(state["used"], F.transform(drawn, lambda r: r["cls"])).alias("used"),
            F.concat(state["drawn"], drawn).alias("drawn"),
        )

    one_type = dict(each.dtypes)["rows"][len("array<"):-1]
    none = F.array_compact(F.array(F.lit(None).cast(one_type)))
    start = F.struct(F.col("rows").alias("left"), F.array().cast("array<string>").alias("used"), none.alias("drawn"))
    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(k * cycle - 1)), start, draw, lambda s: s["drawn"])
    return each.select(by, F.posexplode(drawn).alias("pick", "r")).select(by, "r.*", (F.col("pick") + 1).alias("pick"))


def round_robin_topk(df: DataFrame, by: str, platforms: list[str], k: int) -> DataFrame:
    """One row per class family, dealt tier by tier, at most ``k`` per platform.

    Input columns: ``tier``, ``cls``, ``seq``, ``leader`` (true for the row that
    must come first). The first row of a family is an aggregation; the deal is a
    bounded rank; platforms are a short configured list.
    """
    family = F.regexp_replace("cls", r"-\d+$", "")
    first = (
        df.withColumn("family", family)
        .groupBy(by, "family")
        .agg(F.min_by(F.struct("tier", "cls", "seq", "leader"), "seq").alias("_r"))
        .select(by, "family", "_r.*")
    )
    dealt = top_k(first, [by, "tier"], [F.col("seq").asc()], k, "_n")
    picked = top_k(
        dealt, [by], [F.col("leader").desc(), F.col("_n").asc(), F.col("tier").asc(), F.col("seq").asc()], k, "pick"
    )
    return picked.drop("_n").select("*", F.explode(F.array(*[F.lit(p) for p in platforms])).alias("platform"))


def _vocabulary(common: list[str] | None) -> list[str]:
    return defaults.INCIDENT_TERMS + defaults.VEHICLE_TYPES if common is None else common


def _is_token(token: Column) -> Column:
    # A token begins with a letter or a digit; in bytes, ":" stands right behind the digits.
    digits = (token < ":") & token.rlike(r"^\d+$")
    return (F.length(token) >= 3) & ~token.isin(K.SEARCH_STOPWORDS) & ~digits


def _is_capital(raw: Column) -> Column:
    """True when a token begins with a capital letter; ASCII is told by its bytes, which stand before all others."""
    return F.when(raw < "A", False).when(raw < "[", True).when(raw < "{", False).otherwise(raw.rlike(r"^\p{Lu}"))


def _token_score(token: Column, raw: Column, n: Column, vocabulary: list[str]) -> Column:
    return (
        F.least(F.length(token), F.lit(12))
        + F.when(_is_capital(raw), 4).otherwise(0)
        - F.when(token.isin(vocabulary), 3).otherwise(0)
        - F.when(n > 2, 2).otherwise(0)
    )


def leading_tokens(text: Column, k: int = 8, common: list[str] | None = None) -> Column:
    """The tokens of :func:`top_tokens` of one text, as an array of (token, pos, token_score) in their order."""
    raws = F.transform(F.regexp_extract_all(text, F.lit(SEARCH_TOKEN), 0), lambda r, i: F.struct(F.lower(r).alias("k"), i.alias("pos"), r.alias("raw")))

    def scored(t: Column, n: Column) -> Column:
        score = _token_score(t["k"], t["raw"], n, _vocabulary(common))
        return F.struct((-score).alias("s"), t["pos"].alias("pos"), t["k"].alias("token"))

    def ranked(ts: Column) -> Column:
        # A text that repeats no token, which a set tells, needs no sort to be grouped.
        alone = F.size(F.array_distinct(F.transform(ts, lambda t: t["k"]))) == F.size(ts)
        each = F.when(alone, F.transform(ts, lambda t: scored(t, F.lit(1)))).otherwise(
            F.transform(grouped(ts), lambda g: scored(g["first"], g["n"])))
        return F.slice(F.sort_array(each), 1, k)

    best = let(F.filter(raws, lambda t: _is_token(t["k"])), ranked)
    return F.transform(best, lambda b: F.struct(b["token"].alias("token"), b["pos"].alias("pos"), (-b["s"]).alias("token_score")))


def top_tokens(df: DataFrame, key: str, text: str, k: int = 8, common: list[str] | None = None) -> DataFrame:
    """The ``k`` most distinctive search tokens per text.

    Score: length up to 12, +4 when first written with a capital, -3 for shared
    vocabulary, -2 when used more than twice; earliest first on ties. A text in
    one row is counted and ranked where it stands; only keys in several rows meet
    in a shuffle.
    """
    once, again = split_repeated(df.select(key, text), key)
    out = once.select(key, F.posexplode(leading_tokens(F.col(text), k, common)).alias("_at", "_t")).select(
        key, "_t.*", (F.col("_at") + 1).alias("ordinal"))
    return out if again is None else out.unionByName(_top_tokens_of_rows(again, key, text, k, common))


def _top_tokens_of_rows(df: DataFrame, key: str, text: str, k: int, common: list[str] | None) -> DataFrame:
    toks = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(SEARCH_TOKEN), 0)).alias("pos", "raw"))
    toks = toks.withColumn("token", F.lower("raw")).where(_is_token(F.col("token")))
    grouped_rows = toks.groupBy(key, "token").agg(
        F.count("*").alias("n"), F.min("pos").alias("pos"), F.min_by("raw", "pos").alias("raw")
    )
    score = _token_score(F.col("token"), F.col("raw"), F.col("n"), _vocabulary(common))
    scored = grouped_rows.select(key, "token", "pos", score.alias("token_score"))
    return top_k(scored, [key], [F.col("token_score").desc(), F.col("pos").asc()], k, "ordinal")


def order_sources(df: DataFrame, languages: list[str], key: str = "lang") -> DataFrame:
    """Preference of each source: listed regional languages first, English 50, others 99."""
    pref = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(key))
    return df.withColumn(
        "preference", F.when(pref > 0, pref).when(F.col(key) == "en", 50).otherwise(99).cast("int")
    )


def top_text(df: DataFrame, by: str, order: list[Column], text: str, n: int = 4) -> DataFrame:
    """Texts of the first ``n`` rows per group joined in rank order."""
    kept = top_k(df, [by], order, n, "_n")
    parts = F.sort_array(F.collect_list(F.struct("_n", F.col(text).alias("t"))))
    return kept.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def pick_narrative(df: DataFrame, key: str, text: str, boilerplate: str) -> DataFrame:
    """Longest prose line of each text: over 60 characters, over 8 blanks, no pipe, no boilerplate."""
    line = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    prose = line.where(
        (F.length("line") > 60)
        & (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) > 8)
        & ~F.contains("line", F.lit("|"))
        & ~F.col("line").rlike(boilerplate)
    )
    return prose.groupBy(key).agg(F.max_by("line", F.struct(F.length("line"), -F.col("pos"))).alias("narrative"))
