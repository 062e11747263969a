"""Syndication clustering: ranked leaders, followers, and headline warnings.

Rows of a claim are taken in rank order. A row joins the best-ranked leader with
a similar headline and the same incident, else it becomes a leader. That is a
sequential rule, evaluated here as a fixpoint over whole tables:

* rows alike in headline, day and stated figures have the same neighbours, so
  they collapse to one node first - the only place where large groups of copies
  occur;
* similar headlines are found once, over distinct headlines of a claim; nodes
  without another node of an equal or similar headline lead at once;
* a node stands under its headline, day and figures, and looks under those of
  similar headlines, so one ``min`` per key tells the best node that it meets:
  nodes are never paired;
* a node is certain to lead once no undecided node better than it is met, and
  joins once a leader better than it is met.

Every round decides at least the best undecided node of each claim. Each round
is cut with a reliable checkpoint, so plans stay short and lost executors cost
one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora import constants as K
from corrobora.functions.urls import is_aggregator
from corrobora.operators.similarity import similar, title_keys
from corrobora.session import cut_lineage, spread, stored

# Key parts standing for "any day", "no day", "any figure" and "no figure".
_ANY, _NONE = -(2**31), -(2**31) + 1
_KEY = ["t", "d", "f"]


def _posted(nodes: DataFrame) -> DataFrame:
    """(t, d, f, pos): the keys a node can be found under, by headline, day and stated figure."""
    day = F.unix_date("day")
    days = F.when(day.isNull(), F.array(F.lit(_NONE), F.lit(_ANY))).otherwise(F.array(day, F.lit(_ANY)))
    return _keyed(nodes, "tid", days, [_NONE, _ANY], _ANY).select(*_KEY, "pos")


def _looked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(t, d, f, node, pos): the keys under which every node that is similar and could be the same incident is posted."""
    near = K.SAME_INCIDENT_DAYS
    day = F.unix_date("day")
    days = F.when(day.isNull(), F.array(F.lit(_ANY))).otherwise(
        F.concat(F.sequence(day - near, day + near), F.array(F.lit(_NONE)))
    )
    return _keyed(nodes.join(links, "tid"), "to", days, [_ANY], _NONE).select(*_KEY, "node", "pos")


def _keyed(nodes: DataFrame, title: str, days: Column, bare: list[int], beside: int) -> DataFrame:
    """A row for each day and figure; ``bare`` marks stand for no figures, ``beside`` is added to stated ones."""
    marks = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    figures = F.transform("figures", lambda f: f.cast("bigint"))
    stated = F.when(F.coalesce(F.size("figures"), F.lit(0)) <= 0, marks(bare)).otherwise(F.concat(figures, marks([beside])))
    return nodes.withColumn("t", F.col(title)).withColumn("d", F.explode(days)).withColumn("f", F.explode(stated))


def _best(posts: DataFrame, looks: DataFrame, links: DataFrame) -> DataFrame:
    """(node, best): the best of ``posts`` that a node of ``looks`` meets, where it is ranked before the node."""
    first = _posted(posts).groupBy(*_KEY).agg(F.min("pos").alias("best"))
    met = _looked(looks, links).join(first, _KEY).where(F.col("best") < F.col("pos"))
    return met.groupBy("node").agg(F.min("best").alias("best"))


def with_nodes(rows: DataFrame) -> DataFrame:
    """Adds ``node`` and ``tid``, which rows of a claim alike in headline, day and figures, or in headline, share.

    ``rows`` is (claim_id, article_id, score, title, day, figures).
    """
    digest = lambda *c: F.unhex(F.md5(F.to_json(F.struct(*c), {"ignoreNullFields": "false"})))
    named = F.lower("title").alias("t")
    return rows.where("claim_id IS NOT NULL AND article_id IS NOT NULL").withColumns({
        "node": digest("claim_id", named, "day", F.array_sort("figures").alias("figures")), "tid": digest("claim_id", named)})


def build_nodes(rows: DataFrame) -> DataFrame:
    """(node, tid, claim_id, title, pos, day, figures) of the nodes of ``rows`` (from :func:`with_nodes`).

    A node's position is its best row's (negative score, id).
    """
    pos = F.struct((-F.col("score")).alias("s"), F.col("article_id").alias("a"))
    return rows.groupBy("node").agg(
        F.first("tid").alias("tid"), F.first("claim_id").alias("claim_id"), F.first("title").alias("title"),
        F.min(pos).alias("pos"), F.first("day").alias("day"), F.first("figures").alias("figures"),
    )


def title_links(nodes: DataFrame) -> DataFrame:
    """(tid, to): similar headlines of a claim, both ways, and headlines of several nodes with themselves.

    Equal hashes of keys only make candidates; each pair is verified on its headlines.
    """
    titles = stored(nodes.groupBy("tid").agg(
        F.first("claim_id").alias("claim_id"), F.min("title").alias("title"), F.count("*").alias("n")))
    # Headlines are few bytes and much work: one written file would be one task.
    keys = title_keys(spread(titles, "tid").withColumn("_id", F.struct("claim_id", "tid")), "_id", "title")
    keys = keys.select("_id.tid", F.xxhash64("_id.claim_id", "gram").alias("k"), "post")
    posts, looks = keys.where("post").select("k", F.col("tid").alias("a")), keys.where("NOT post").select("k", F.col("tid").alias("b"))
    # Every similar pair meets both ways, so one of them is enough.
    pairs = posts.join(looks, "k").where("a < b").select("a", "b").distinct()
    side = lambda x: titles.select(F.col("tid").alias(x), F.col("title").alias(f"{x}_title"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").where(similar("a_title", "b_title")[1])
    both = F.inline(F.array(*[F.struct(F.col(x).alias("tid"), F.col(y).alias("to")) for x, y in ("ab", "ba")]))
    own = titles.where("n > 1").where(similar("title", "title")[1]).select("tid", F.col("tid").alias("to"))
    return stored(found.select(both).unionByName(own))


def elect_leaders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, tid, pos, day, figures) of the leaders among ``nodes``; every other node joins one."""
    bound = nodes.select("node", "tid", "pos", "day", "figures")
    linked = links.select("tid").distinct()
    leaders = bound.join(linked, "tid", "left_anti")
    open_nodes = cut_lineage(bound.join(linked, "tid", "left_semi"))
    while not open_nodes.isEmpty():
        judged = cut_lineage(open_nodes.join(_best(open_nodes, open_nodes, links), "node", "left"))
        new, rest = judged.where("best IS NULL").drop("best"), judged.where("best IS NOT NULL").drop("best")
        open_nodes = cut_lineage(rest.join(_best(new, rest, links), "node", "left_anti"))
        leaders = leaders.unionByName(new)
    return leaders


def collapse_stories(rows: DataFrame) -> DataFrame:
    """Adds ``story_id`` (the leader's article) and ``distinct_incident`` to each row.

    A row is flagged when its headline matches a leader ranked before its own
    story's leader but the incident differs; that leader is flagged too.
    """
    keyed = with_nodes(rows)
    nodes = stored(build_nodes(keyed))
    links = title_links(nodes)
    leaders = elect_leaders(nodes, links)
    rest = nodes.join(leaders.select("node"), "node", "left_anti")
    lead = stored(
        leaders.select("node", "tid", "pos", F.col("pos").alias("lead_pos")).unionByName(
            rest.select("node", "tid", "pos").join(_best(leaders, rest, links).withColumnRenamed("best", "lead_pos"), "node"))
    )
    flags = headline_warnings(lead, links)
    return (
        keyed.join(lead.select("node", "lead_pos"), "node").join(flags, "node", "left")
        .withColumn("story_id", F.col("lead_pos.a"))
        .withColumn("distinct_incident", F.coalesce("flagged", F.lit(False)))
        .select(*rows.columns, "story_id", "distinct_incident")
    )


def headline_warnings(lead: DataFrame, links: DataFrame) -> DataFrame:
    """(node, flagged) of nodes with the headline of an earlier leader that is another incident, and of those leaders.

    ``lead`` is (node, tid, pos, lead_pos). A similar leader ranked before a node's own leader is another incident, else
    the node would have joined it; so the best leader and the last story of each headline tell, and no pairs are made.
    """
    ends = lead.groupBy("tid").agg(
        F.min(F.when(F.col("pos") == F.col("lead_pos"), F.col("pos"))).alias("first"), F.max("lead_pos").alias("last"))
    seen = links.join(ends.withColumnRenamed("tid", "to"), "to").groupBy("tid").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    after = F.col("first") < F.col("lead_pos")
    before = (F.col("pos") == F.col("lead_pos")) & (F.col("last") > F.col("pos"))
    clash = F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))
    return lead.join(seen, "tid").where(clash).select("node", F.lit(True).alias("flagged"))


def choose_representative(stories: DataFrame) -> DataFrame:
    """One row per story: a direct publisher link before an aggregator's, then the best rank.

    Keeps the longest snippet and the earliest date of the story. Input columns:
    claim_id, story_id, article_id, url, snippet, day, score.
    """
    order = F.struct(is_aggregator(F.col("url")), -F.col("score"), F.col("article_id"))
    agg_url = F.when(is_aggregator(F.col("url")), F.col("url"))
    return stories.groupBy("claim_id", "story_id").agg(
        F.min_by("article_id", order).alias("article_id"),
        F.min_by("url", order).alias("url"),
        F.min(agg_url).alias("aggregator_url"),
        F.max_by("snippet", F.struct(F.length("snippet"), "snippet")).alias("snippet"),
        F.min("day").alias("day"),
        F.max("score").alias("score"),
        F.count("*").alias("n_copies"),
    )
