"""URL expressions: canonical form, host, publisher, words, redirects, safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora import defaults
from corrobora.functions.text import let


def host_of(url: Column) -> Column:
    """Lower-cased host without ``www.``; empty when the URL cannot be read."""
    h = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` to ``[a.b.c, b.c, c]``, so a suffix test becomes an equality test."""
    tails = lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")
    )
    return F.when(host != "", let(F.split(host, r"\."), tails)).otherwise(F.array().cast("array<string>"))


def host_in(host: Column, hosts: list[str]) -> Column:
    """True when the host, or a parent domain of it, is listed."""
    return F.exists(host_suffixes(host), lambda s: s.isin(hosts))


def is_aggregator(url: Column) -> Column:
    return host_in(host_of(url), K.AGGREGATOR_HOSTS)


def publisher(url: Column, reported: Column) -> Column:
    """Publishing host: the URL's, unless it is an aggregator with a reported domain."""
    host = host_of(url)
    rep = F.coalesce(F.lower(F.regexp_replace(reported, r"^www\.", "")), F.lit(""))
    return F.when((rep != "") & ((host == "") | host_in(host, K.AGGREGATOR_HOSTS)), rep).when(
        host != "", host
    ).otherwise(rep)


def canonical_url(url: Column) -> Column:
    """Comparison form: no scheme, ``www.``, fragment, tracking parameter, ``/amp`` or trailing slash."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(path, "/+$", ""), "(?i)/amp$", "")
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(K.TRACKING_PARAMS)),
        "&",
    )
    full = F.concat(
        F.regexp_replace(host, r"^www\.", ""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")
    )
    return F.lower(F.coalesce(full, url))


def url_words(url: Column) -> Column:
    """Host and path as space-separated words."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(F.concat(host, F.lit(" "), path), r"[/\-_.]+", " "), r"\s+", " "))


def is_browsable(url: Column) -> Column:
    """Absolute http(s) URL with a host."""
    return F.coalesce(
        F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
        & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != ""),
        F.lit(False),
    )


def is_index_page(url: Column) -> Column:
    """Front page, profile, search or listing page rather than a single post."""
    path = F.try_parse_url(url, F.lit("PATH"))
    p = F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", "")
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    names, folders = "|".join(K.INDEX_PAGE_NAMES), "|".join(K.INDEX_PAGE_FOLDERS)
    bare_post = p.rlike(r"(?i)^/(watch|story\.php|permalink\.php|photo\.php|video\.php)$")
    return (
        F.try_parse_url(url, F.lit("HOST")).isNull()
        | (p == "")
        | F.when(bare_post, F.length(query) < 2).otherwise(
            p.rlike(f"(?i)^/({names})$") | p.rlike(f"(?i)^/({folders})/")
        )
    )


def unwrap_url(url: Column, param: str = "url") -> Column:
    """Target of a redirect link: a query parameter, plain or base64url; else the URL itself."""
    raw = F.regexp_extract(url, rf"[?&]{param}=([^&#]+)", 1)
    plain = F.try_url_decode(raw)
    coded = F.translate(F.regexp_replace(raw, "^a1", ""), "-_", "+/")
    padded = F.rpad(coded, (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return (
        F.when(plain.rlike("^https?://"), plain)
        .when(decoded.rlike("^https?://"), decoded)
        .otherwise(url)
    )


def tier_score(host: Column, tiers: list[tuple[int, list[str]]] | None = None) -> Column:
    """Trust score of a host by the first tier listing it or a parent domain."""
    tiers = defaults.DOMAIN_TIERS if tiers is None else tiers

    def by_suffix(suffixes: Column) -> Column:
        score = F.when(F.size(suffixes) == 0, F.lit(0))
        for value, hosts in tiers:
            score = score.when(F.arrays_overlap(suffixes, F.array(*[F.lit(h) for h in hosts])), F.lit(value))
        return score.otherwise(F.lit(K.UNKNOWN_HOST_SCORE))

    return let(host_suffixes(host), by_suffix)


def category(url: Column, source: Column, social: Column, authoritative: Column) -> Column:
    """Source category, in the order Social, YouTube, News, Web."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(social, "Social")
        .when(F.contains(u, F.lit("youtube.com")) | F.contains(u, F.lit("youtu.be")), "YouTube")
        .when((source == "News") | authoritative, "News")
        .otherwise("Web")
    )
