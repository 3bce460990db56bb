"""Structural proximity of notes: links, folders, names, times; re-rank of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import base_name, char_bigrams, epoch_micros, folder_segments
from noteloom.runtime import BROADCAST_ROWS, rounded, stage

# --- fixed values: weights of the four parts and the link scores by distance ---
WEIGHTS = {"link": 0.4, "folder": 0.3, "name": 0.15, "time": 0.15}
LINK_SELF, LINK_ONE, LINK_TWO = 1.0, 0.8, 0.4
HALF_WIDTH_DAYS = 7
# -------------------------------------------------------------------------------
HUB_PART = 10_000  # neighbours
_HUBS = 100_000


def folder_score(a: Column | str, b: Column | str) -> Column:
    """Common leading folders over the deeper path's depth; two root notes score 1."""
    sa, sb = folder_segments(a), folder_segments(b)
    depth = F.greatest(F.size(sa), F.size(sb))
    same = F.zip_with(sa, sb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_difference = F.array_position(same, F.lit(False))
    common = F.when(first_difference > 0, first_difference - 1).otherwise(depth)
    return F.when(depth == 0, F.lit(1.0)).otherwise(common / depth)


def name_score(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the character bigrams of two names."""
    ba = F.array_distinct(char_bigrams(F.lower(a)))
    bb = F.array_distinct(char_bigrams(F.lower(b)))
    both = F.size(F.array_intersect(ba, bb))
    na, nb = F.size(ba), F.size(bb)
    return (
        F.when((na == 0) & (nb == 0), F.lit(1.0))
        .when((na == 0) | (nb == 0), F.lit(0.0))
        .otherwise(both / (na + nb - both))
    )


def time_score(a: Column | str, b: Column | str) -> Column:
    """exp(-days apart / 7); 0 when the second note is unknown."""
    days = F.abs(epoch_micros(a) - epoch_micros(b)) / F.lit(86_400_000_000.0)
    return F.coalesce(F.exp(-days / F.lit(float(HALF_WIDTH_DAYS))), F.lit(0.0))


def _split_hubs(arcs: DataFrame, n_arcs: int, degree: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """(arcs, parts): arcs (near, mid, _part) with the lists of hubs dealt to parts; (src, _parts) of every hub.

    A hub has more than ``part`` neighbours and more than 1/100,000 of all arcs, so there are never more than
    100,000 of them and they may be broadcast, whatever the graph.
    """
    size = max(part, n_arcs // _HUBS)
    hubs = degree.where(F.col("deg") > size).select("src", F.ceil(F.col("deg") / size).cast("int").alias("_parts"))
    dealt = arcs.join(F.broadcast(hubs), "src", "left").select(
        F.col("src").alias("near"),
        F.col("dst").alias("mid"),
        F.pmod(F.xxhash64("dst"), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part"),
    )
    return dealt, hubs


def link_scores(pairs: DataFrame, graph: DataFrame, few: int = BROADCAST_ROWS // 2, part: int = HUB_PART) -> DataFrame:
    """(anchor, target, link): 1 for the note itself, 0.8 for a neighbour, 0.4 for two hops, else 0.

    A two-hop test asks whether two neighbour lists meet. Only the shorter list of each pair is
    expanded and its members are looked up as (middle, other end) edges, so a hub is expanded only
    when both ends are hubs. Up to ``few`` pairs are broadcast to the graph, which then is not shuffled.
    Beyond that pairs and lists meet by shuffle, and the list of a hub is split by its counted length into parts of about
    ``part`` neighbours, tasks of their own. Only the distinct pairs are staged.
    """
    asked = stage(pairs.select("anchor", "target").distinct())
    small = asked.count() <= few
    sent = F.broadcast if small else (lambda df: df)
    arcs = graph.select(F.col("src").alias("anchor"), F.col("dst").alias("target"))
    one = arcs.join(sent(asked), ["anchor", "target"], "left_semi").withColumn("_one", F.lit(True))
    apart = asked.where(F.col("anchor") != F.col("target")).join(sent(one), ["anchor", "target"], "left_anti")
    ends = sent(apart.select(F.explode(F.array("anchor", "target")).alias("src")).distinct())
    touched = graph.select("src", "dst").join(ends, "src", "left_semi")
    degree = sent(touched.groupBy("src").agg(F.count("*").alias("deg")))
    sized = apart.join(degree.select(F.col("src").alias("anchor"), F.col("deg").alias("_da")), "anchor").join(
        degree.select(F.col("src").alias("target"), F.col("deg").alias("_dt")), "target"
    )
    swap = F.col("_da") > F.col("_dt")
    probes = sized.select(
        "anchor",
        "target",
        F.when(swap, F.col("target")).otherwise(F.col("anchor")).alias("near"),
        F.when(swap, F.col("anchor")).otherwise(F.col("target")).alias("far"),
    )
    if small:
        met = touched.select(F.col("src").alias("near"), F.col("dst").alias("mid")).join(F.broadcast(probes), "near")
    else:
        lists, hubs = _split_hubs(touched, graph.count(), degree, part)
        split = probes.join(F.broadcast(hubs.withColumnRenamed("src", "near")), "near", "left").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        )
        met = lists.join(split, ["near", "_part"])
    two = (
        met.join(touched.select(F.col("src").alias("far"), F.col("dst").alias("mid")), ["far", "mid"], "left_semi")
        .select("anchor", "target")
        .distinct()
        .withColumn("_two", F.lit(True))
    )
    score = (
        F.when(F.col("anchor") == F.col("target"), LINK_SELF)
        .when(F.col("_one"), LINK_ONE)
        .when(F.col("_two"), LINK_TWO)
        .otherwise(0.0)
    )
    return (
        asked.join(sent(one), ["anchor", "target"], "left")
        .join(sent(two), ["anchor", "target"], "left")
        .select("anchor", "target", score.alias("link"))
    )


def proximity_scores(pairs: DataFrame, notes: DataFrame, graph: DataFrame) -> DataFrame:
    """(anchor, target, link, folder, name, time, proximity) for distinct (anchor, target) pairs."""
    times = notes.select("path", "mtime")
    scored = (
        link_scores(pairs, graph)
        .join(times.select(F.col("path").alias("anchor"), F.col("mtime").alias("_ma")), "anchor", "left")
        .join(times.select(F.col("path").alias("target"), F.col("mtime").alias("_mt")), "target", "left")
        .select(
            "anchor",
            "target",
            "link",
            folder_score("anchor", "target").alias("folder"),
            name_score(base_name("anchor"), base_name("target")).alias("name"),
            time_score("_ma", "_mt").alias("time"),
        )
    )
    total = sum(F.lit(w) * F.col(part) for part, w in WEIGHTS.items())
    return scored.withColumn("proximity", rounded(total))


def proximity_rerank(results: DataFrame, anchors: DataFrame, notes: DataFrame, graph: DataFrame, boost: float = 0.5) -> DataFrame:
    """Re-order each query's result rows by ``score * (1 + boost * proximity)``.

    ``results`` has (query_id, path, score, rank), ``anchors`` (query_id, anchor). Queries without an
    anchor keep their order. Only the returned rows move; nothing enters or leaves the list.
    """
    if not 0 <= boost <= 1:
        raise ValueError("boost must lie in 0..1")
    rows = results.join(anchors, "query_id", "left")
    pairs = rows.where(F.col("anchor").isNotNull()).select("anchor", F.col("path").alias("target"))
    prox = proximity_scores(pairs, notes, graph).select("anchor", F.col("target").alias("path"), "proximity")
    boosted = rows.join(prox, ["anchor", "path"], "left").withColumn(
        "score",
        F.when(F.col("proximity").isNull(), F.col("score")).otherwise(
            rounded(F.col("score") * (1 + F.lit(float(boost)) * F.col("proximity")))
        ),
    )
    return boosted.withColumnRenamed("rank", "rank_before").withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank_before")).cast("int")
    ).drop("anchor")
