"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words; a document of a source is then wanted ``target / source size``
times. The whole part of that number is taken as copies. The fractional parts are rounded to 0 or 1 so that
the expected words are kept: two documents fight, words move from one to the other until one of the two is
decided, and the other one goes on with the rest. The direction is drawn so that every document keeps
its probability. Large documents fight first, so that the last undecided one is likely to be small.

The fights form a tree. Documents of a source are cut into blocks of neighbours in size; each block is
one row that a fold reduces to decisions and one undecided document. The undecided ones of neighbouring
blocks form the blocks of the next level, until one document per source is left, which is rounded by
its own probability. All random numbers are hashes of the ids, so reruns agree. Only DataFrame functions
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import WHITE, hold, staged, text_key, uniform

BLOCK = 64
REPEATS = 3.0
WEIGHTS = (1, 2, 3)
_EPS = 1e-9


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size, n_docs, target) from one row per document (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, repeating. A target is ``level * weight``, but
    at most ``repeats`` times the source's size; the level makes the targets add up to all words. Sources
    that the limit cuts come first in the order of limit / weight, so one running sum finds the level.
    The windows here hold one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    per = per.withColumn("place", place)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, F.pmod("place", F.lit(len(weights)))))
    per = per.withColumn("limit", F.col("source_size") * F.lit(repeats))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words_left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", words_left / weight_left)
    per = per.withColumn("free", F.col("limit") / F.col("weight") >= F.col("level"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(everything)
    target = F.when(F.col("free"), F.col("weight") * level).otherwise(F.col("limit"))
    return per.select("source", "source_size", "n_docs", F.least(target, F.col("limit")).alias("target"))


def _fold(items: str, salt: Column) -> Column:
    """Reduce an ordered array of (p, id, key) to its decisions and one undecided entry."""
    first = F.get(F.col(items), F.lit(0))
    decided = F.filter(F.col(items), lambda x: F.lit(False))
    start = F.struct(first.alias("open"), decided.alias("done"))

    def fight(state, b):
        a = state["open"]
        mass_a, room_a = a["p"] * a["size"], (1 - a["p"]) * a["size"]
        mass_b, room_b = b["p"] * b["size"], (1 - b["p"]) * b["size"]
        up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)  # words that can move to a, or to b
        to_a = uniform(salt, a["key"], b["key"], a["id"], b["id"]) * (up + down) < down
        a_done = F.when(to_a, room_a <= mass_b).otherwise(mass_a <= room_b)
        a_rest = F.when(to_a, mass_a + up).otherwise(mass_a - down) / a["size"]
        b_rest = F.when(to_a, mass_b - up).otherwise(mass_b + down) / b["size"]
        stays = F.when(a_done, b.withField("p", b_rest)).otherwise(a.withField("p", a_rest))
        # who is decided has reached a bound: the receiver 1, the giver 0
        leaves = F.when(a_done, a.withField("p", to_a.cast("double"))).otherwise(b.withField("p", (~to_a).cast("double")))
        return F.struct(stays.alias("open"), F.concat(state["done"], F.array(leaves)).alias("done"))

    return F.aggregate(F.slice(F.col(items), F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, fight)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: float = REPEATS,
    block: int = BLOCK,
    seed: int = 17,
) -> DataFrame:
    """(doc_id, tkey, size, source, source_size, target, copies, taken) for every row of ``docs``.

    ``docs`` has doc_id, text and source. A null text has size 0; a document of size 0 has 0 copies.
    A null source is a source of its own and the last one. Rows with equal ids stay separate rows. If
    there are no words at all every target is 0. An empty table gives an empty result.
    """
    rows = staged(docs.select("doc_id", "source", text_key().alias("tkey"), n_words().alias("size")))
    targets = staged(source_targets(rows, weights, repeats))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    # rank of each size within its source, from a histogram: one row per source and size
    by_size = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rates = targets.withColumn("rate", F.least(rate, F.lit(repeats))).drop("n_docs")
    by_size = staged(
        by_size.join(rates, by_size["source"].eqNullSafe(rates["source"]))
        .drop(rates["source"])
        .select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "before", "rate", "source_size", "target")
    )
    placed = rows.join(by_size, rows["source"].eqNullSafe(by_size["s"]) & (rows["size"] == by_size["z"]))
    spread = F.pmod(uniform(F.lit(seed), F.col("doc_id"), F.col("tkey")) * F.ceil(F.col("n") / block), F.ceil(F.col("n") / block))
    at = F.floor(F.col("before") / block) + F.floor(spread)
    whole = F.floor(F.col("rate") + _EPS)
    part = F.col("rate") - whole
    part = F.when(part < _EPS, F.lit(0.0)).otherwise(part)
    placed = placed.withColumn("whole", whole).withColumn("p", part).withColumn("at", at.cast("long"))

    level = (
        placed.groupBy("source", "at")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("size", "tkey", F.col("doc_id").alias("id"), "p")
                ),
                asc=False,
            ).alias("items"),
            F.first("whole").alias("whole"),
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
        )
        .withColumn(
            "items",
            F.transform(
                "items",
                lambda x: F.struct(x["p"].alias("p"), x["id"].alias("id"), x["tkey"].alias("key"), x["size"].alias("size")),
            ),
        )
    )
    kept_columns = ["source", "whole", "source_size", "target"]
    decided = None
    depth = 0
    while True:
        folded = hold(level, _fold("items", F.lit(seed + depth)).alias("state"))
        folded = staged(folded.select(*kept_columns, "at", F.col("state.open").alias("open"), F.col("state.done").alias("done")))
        done = folded.select(*kept_columns, F.explode("done").alias("d"))
        decided = done if decided is None else decided.unionByName(done)
        top = folded.agg(F.max("at")).first()[0]
        if not top:  # null: no rows at all
            break
        depth += 1
        level = (
            folded.select(*kept_columns, "open", F.col("at").alias("from"), F.floor(F.col("at") / block).alias("at"))
            .groupBy("source", "at")
            .agg(
                F.transform(F.sort_array(F.collect_list(F.struct("from", "open"))), lambda x: x["open"]).alias("items"),
                *[F.first(c).alias(c) for c in kept_columns[1:]],
            )
        )
    last = folded.select(*kept_columns, F.col("open").alias("d"))
    lucky = uniform(F.lit(seed), F.lit("last"), F.col("d.id"), F.col("d.key")) < F.col("d.p")
    last = last.withColumn("d", F.col("d").withField("p", lucky.cast("double")))
    copies = F.round(F.col("whole") + F.col("d.p")).cast("int")
    empty = rows.where("size = 0").join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "tkey", "size", rows["source"], "source_size", "target", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken")
    )
    mixed = decided.unionByName(last).select(
        F.col("d.id").alias("doc_id"),
        F.col("d.key").alias("tkey"),
        F.col("d.size").alias("size"),
        "source",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("d.size")).cast("long").alias("taken"),
    )
    return mixed.unionByName(empty)


def take_mix(docs: DataFrame) -> DataFrame:
    """The rows of the mix, columns unchanged: a row is repeated as often as it was taken, or left out.

    Rows that are equal in id, text and source share their copies evenly, up to one.
    """
    taken = mix(docs).groupBy("doc_id", "tkey", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = staged(taken.select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), F.col("source").alias("_s"), "copies", "rows"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), text_key().alias("_k"), "doc_id", "source")
    match = (
        packed["doc_id"].eqNullSafe(taken["_d"]) & (packed["_k"] == taken["_t"]) & packed["source"].eqNullSafe(taken["_s"])
    )
    joined = packed.join(taken.where("copies > 0"), match)
    single = joined.where("rows = 1").select("_row", F.explode(F.sequence(F.lit(1), "copies")))
    same = Window.partitionBy("doc_id", "_k", "source").orderBy("_k")
    many = joined.where("rows > 1").withColumn("nth", F.row_number().over(same) - 1)
    share = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") < F.col("copies") % F.col("rows")).cast("int")
    many = many.withColumn("share", share).where("share > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "share")))
    return single.select("_row.*").unionByName(many.select("_row.*"))
