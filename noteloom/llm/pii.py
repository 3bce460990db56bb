"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Looser patterns propose
further candidates, for example a number that runs into the next one. Five labelers (pattern, validity,
gazetteer, context words, borders) vote yes, no or nothing on each candidate. An expectation-maximisation
over the counted vote patterns estimates how reliable each labeler is and how likely each pattern is to be
personal data. These probabilities are the soft labels of a naive Bayes classifier over votes, shape and
neighbourhood, which accepts or rejects every candidate.

Everything is built from DataFrame functions; EM runs on a table of at most 4 * 3^5 pattern counts and the
classifier has a fixed number of cells. Patterns avoid repeated groups, so long runs neither recurse nor
backtrack. Positions are sums of the lengths between and of matches, in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import hold, small, staged, text_key

KINDS = ("email", "ip", "card", "phone")
# The base patterns. In the card text \x01 stands for a single blank or dash between two digits,
# in the email text \x02 stands for a dot between two characters of a domain.
_LOCAL = r"[A-Za-z0-9._%+\x02-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\x02[A-Za-z0-9\x02-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9\x01])[0-9\x01]{16,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+ ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,24}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[0-9]{0,3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP_VALID = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
# Gazetteers and context words of the labelers.
TOP_DOMAINS = "com org net edu gov io de fr es it uk eu info biz us ca ch at be nl"
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
PHONE_CODES = r"^\+?(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|correo|courriel)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|mastercard|credit|karte|carte|tarjeta)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|t[ée]l[ée]fono)\W*(?:\w+\W+)?$",
}
AGAINST = r"(?i)(?:version|\bv|isbn|issn|order|invoice|build|release|serial|article|\bno|#|\$|€)\W*$"
LABELERS = ("v_shape", "v_valid", "v_list", "v_cue", "v_edge")
CELLS = 256
ROUNDS = 40


def _found(t: str, kind: str, source: int, pattern: str, when: Column) -> list[Column]:
    """Two columns for ``hold``: all matches and all pieces between them, or empty arrays."""
    none = F.array().cast("array<string>")
    name = f"_{kind}{source}"
    return [
        F.when(when, F.regexp_extract_all(F.col(t), F.lit(pattern), F.lit(0))).otherwise(none).alias(name + "m"),
        F.when(when, F.split(F.col(t), pattern, -1)).otherwise(none).alias(name + "p"),
    ]


def _spans(kind: str, base: int) -> Column:
    pieces = F.col(f"_{kind}{base}p")

    def span(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(base).alias("base"),
            i.cast("int").alias("seq"),
            F.length(F.get(pieces, i)).alias("gap"),
            F.translate(x, "\x01\x02", " .").alias("match"),
            F.substring(F.get(pieces, i), -40, 40).alias("before"),
            F.substring(F.get(pieces, i + 1), 1, 8).alias("after"),
            F.length(x).alias("size"),
        )

    return F.transform(f"_{kind}{base}m", span)


def candidate_spans(docs: DataFrame) -> DataFrame:
    """One row per base match and loose candidate, and one with a null kind for a row without any.

    ``uid`` tells the rows of ``docs`` apart; the result is written, so it keeps them.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_key().alias("tkey"), t.alias("t"))
    digits = F.col("t").rlike("[0-9]")
    at, dotted = F.col("t").contains("@"), F.col("t").rlike(r"[0-9]\.[0-9]")
    long_number = digits & F.col("t").rlike(r"[0-9](?:[ -]?[0-9]){15}")
    dots = F.regexp_replace(F.translate("t", "\x02", "\x03"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x02")
    joins = F.regexp_replace(F.translate("t", "\x01", "\x03"), r"(?<=[0-9])[ -](?=[0-9])", "\x01")
    rows = hold(
        rows,
        at.alias("at"),
        dotted.alias("dotted"),
        long_number.alias("long_number"),
        digits.alias("digits"),
        F.when(at, dots).alias("t_email"),
        F.when(long_number, joins).alias("t_card"),
    )
    obscured = F.col("t").rlike(r"[\[(]at[\])]")
    wanted = {
        ("email", 1): ("t_email", BASE["email"], F.col("at")),
        ("ip", 1): ("t", BASE["ip"], F.col("dotted")),
        ("card", 1): ("t_card", BASE["card"], F.col("long_number")),
        ("phone", 1): ("t", BASE["phone"], F.col("digits") & F.col("t").contains("+")),
        ("email", 0): ("t", LOOSE["email"], obscured),
        ("ip", 0): ("t", LOOSE["ip"], F.col("dotted")),
        ("card", 0): ("t", LOOSE["card"], F.col("long_number")),
        ("phone", 0): ("t", LOOSE["phone"], F.col("digits") & F.col("t").rlike("[0-9]{3}[ .-][0-9]{4}")),
    }
    columns = [c for (kind, base), (text, pattern, when) in wanted.items() for c in _found(text, kind, base, pattern, when)]
    rows = hold(rows, *columns)
    spans = [_spans(kind, base) for kind, base in wanted]
    found = rows.select("uid", "doc_id", "tkey", F.explode_outer(F.concat(*spans)).alias("s"))
    found = staged(found.select("uid", "doc_id", "tkey", "s.*"))
    order = Window.partitionBy("uid", "kind", "base").orderBy("seq")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).drop("gap", "seq")


def luhn(digits: Column) -> Column:
    """True if the check digit of a string of digits is right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(
        values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _votes(spans: DataFrame) -> DataFrame:
    """Adds ``valid`` (the base rule of the kind) and the labelers' votes: 1, -1 or 0 for no vote."""
    m, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    by_kind = lambda *c: F.when(kind == 0, c[0]).when(kind == 1, c[1]).when(kind == 2, c[2]).otherwise(c[3])
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    tail = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
    in_list = F.array_contains(F.array(*[F.lit(d) for d in TOP_DOMAINS.split()]), tail)
    spans = spans.withColumn(
        "valid",
        by_kind(F.lit(True), m.rlike(IP_VALID), n.between(16, 19) & luhn(digits), n.between(8, 15)),
    )
    loose = by_kind(
        m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@"),
        m.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"),
        m.rlike(r"^(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"),
        m.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"),
    )
    listed = by_kind(
        F.when(in_list, yes).otherwise(no),
        F.when(m.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), no).otherwise(none),
        F.when(digits.rlike(CARD_PREFIX), yes).otherwise(no),
        F.when(m.startswith("+"), F.when(m.rlike(PHONE_CODES), yes).otherwise(no)).otherwise(none),
    )
    cue = by_kind(*[F.when(F.col("before").rlike(CUES[k]), yes) for k in KINDS])
    edge = F.col("before").rlike(r"[\p{L}0-9_]$") | F.col("after").rlike(r"^[\p{L}0-9_]")
    return (
        spans.withColumn("v_shape", F.when(loose, yes).otherwise(no))
        .withColumn("v_valid", F.when(F.col("valid"), yes).otherwise(no))
        .withColumn("v_list", listed)
        .withColumn("v_cue", F.coalesce(cue, F.when(F.col("before").rlike(AGAINST), no), none))
        .withColumn("v_edge", F.when(edge, no).otherwise(yes))
    )


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern to be personal data, by EM over the counted patterns of one kind.

    The model gives each labeler its own chances of the three votes for true and for false candidates. It
    starts from the majority of votes; a weak prior keeps labelers better than chance.
    """
    total = sum(counts.values())
    belief = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v in counts}
    for _ in range(rounds):
        true = sum(belief[v] * n for v, n in counts.items())
        prior = (true + 1) / (total + 2)
        chance = []
        for k in range(len(LABELERS)):
            hit = {1: (2.0, 1.0), 0: (1.0, 1.0), -1: (1.0, 2.0)}  # pseudo votes for true, for false
            for v, n in counts.items():
                a, b = hit[v[k]]
                hit[v[k]] = (a + belief[v] * n, b + (1 - belief[v]) * n)
            sums = [sum(h[c] for h in hit.values()) for c in (0, 1)]
            chance.append({x: (h[0] / sums[0], h[1] / sums[1]) for x, h in hit.items()})
        for v in counts:
            log = math.log(prior / (1 - prior))
            log += sum(math.log(chance[k][x][0] / chance[k][x][1]) for k, x in enumerate(v))
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return belief


def _features() -> Column:
    """Cells of a candidate: votes, shape, word before, sign after."""
    shape = F.regexp_replace(F.regexp_replace("match", "[0-9]", "0"), "[A-Za-z]+", "a")
    word = F.lower(F.regexp_extract("before", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    after = F.regexp_replace(F.substring("after", 1, 1), r"\p{L}", "a")
    cell = lambda name, c: F.concat(F.lit(name + ":"), F.pmod(F.xxhash64(c), F.lit(CELLS)).cast("string"))
    votes = [F.concat(F.lit(v + ":"), F.col(v).cast("string")) for v in LABELERS]
    return F.array(*votes, cell("shape", shape), cell("word", word), cell("after", after))


def find_spans(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, tkey, kind, base, start, end): base and accepted spans; a null kind for rows without any."""
    spans = staged(_votes(candidate_spans(docs)))
    some = spans.where("kind is not null")
    counted = some.groupBy("kind", *LABELERS).count().collect()  # at most 4 * 3^5 rows
    beliefs = []
    for kind in range(len(KINDS)):
        counts = {tuple(r[v] for v in LABELERS): r["count"] for r in counted if r["kind"] == kind}
        beliefs += [(kind, *votes, p) for votes, p in reliabilities(counts).items()]
    columns = "kind int, " + ", ".join(f"{v} int" for v in LABELERS) + ", belief double"
    beliefs = docs.sparkSession.createDataFrame(beliefs, columns)  # one row per counted pattern
    labelled = some.join(F.broadcast(beliefs), ["kind", *LABELERS]).withColumn("feature", F.explode(_features()))
    table = labelled.groupBy("kind", "feature").agg(F.sum("belief").alias("t"), F.sum(1 - F.col("belief")).alias("f"))
    table = table.select("kind", "feature", F.round("t", 6).alias("t"), F.round("f", 6).alias("f"))
    totals = table.where("feature like 'v_shape:%'").groupBy("kind").agg(F.sum("t").alias("tt"), F.sum("f").alias("ff"))
    table = table.join(F.broadcast(totals), "kind")  # 4 rows
    odds = F.log((F.col("t") + 0.5) / (F.col("tt") + 1)) - F.log((F.col("f") + 0.5) / (F.col("ff") + 1))
    prior = F.log((F.col("tt") + 1) / (F.col("ff") + 1))
    table = staged(table.select("kind", "feature", odds.alias("odds"), prior.alias("prior")))

    keys = ["uid", "kind", "base", "start", "end"]
    loose = some.where("base = 0")
    scored = loose.select(*keys, F.explode(_features()).alias("feature"))
    scored = scored.join(F.broadcast(table), ["kind", "feature"])  # at most 4 * (5 * 3 + 3 * CELLS) rows
    scored = scored.groupBy(*keys).agg((F.sum("odds") + F.first("prior")).alias("score")).where("score > 0")

    kept = spans.where("kind is null or (base = 1 and valid)").select("uid", "doc_id", "tkey", "kind", "base", "start", "end")
    ids = spans.select("uid", "doc_id", "tkey").distinct()
    more = scored.join(ids, "uid").select(*kept.columns)
    both = kept.where("kind is not null").union(more)
    # a loose span goes if it overlaps a base span of its kind, before or after its own start
    order = Window.partitionBy("uid", "kind").orderBy("start", "base")
    before = F.max(F.when(F.col("base") == 1, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(F.col("base") == 1, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_b", before).withColumn("_f", following)
    free = (F.coalesce(F.col("_b") <= F.col("start"), F.lit(True))) & (F.coalesce(F.col("_f") >= F.col("end"), F.lit(True)))
    both = both.where((F.col("base") == 1) | free).drop("_b", "_f")
    return both.union(ids.select("uid", "doc_id", "tkey", *[F.lit(None).cast(both.schema[c].dataType).alias(c) for c in ("kind", "base", "start", "end")]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs`` (doc_id, text, ...).

    Counts and ``base_sha256`` cover base spans, ``spans`` also the accepted ones. A null text counts as
    empty. Rows with equal ids stay separate rows. An empty table gives an empty result; other columns are
    ignored. The spans of one text are gathered in one place, those of different texts never.
    """
    spans = find_spans(docs)
    item = F.struct("kind", "start", "end", "base")
    per = spans.groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), item))).alias("all"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(items: Column) -> Column:
        return F.array_join(
            F.transform(items, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))),
            ",",
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("all", lambda x: (x["base"] == 1) & (x["kind"] == kind))).cast("long")

    base = F.filter("all", lambda x: x["base"] == 1)
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return per.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    Other columns, of any name, keep their values, and so does a null or empty text. Rows that repeat are all redacted; an
    empty table gives an empty result.
    """
    spans = find_spans(docs).where("kind is not null")
    order = Window.partitionBy("uid").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))
    spans = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    merged = spans.groupBy("uid", "doc_id", "tkey", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind")
    )
    per = merged.groupBy("uid", "doc_id", "tkey").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    per = staged(per.groupBy(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")).agg(F.first("cuts").alias("_cuts")))
    weight = per.agg(F.sum(40 + 16 * F.size("_cuts"))).first()[0] or 0
    per = small(per, int(weight / max(1, per.count())) + 1)
    keyed = docs.select(F.col("doc_id").alias("_i"), F.col("text").alias("_text"), text_key().alias("_key"), F.struct(*docs.columns).alias("_row"))
    keyed = keyed.join(per, keyed["_i"].eqNullSafe(per["_d"]) & (keyed["_key"] == per["_t"]), "left")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text, cuts = F.col("_text"), F.col("_cuts")
    parts = F.transform(
        cuts,
        lambda c, i: F.concat(
            F.substring(text, F.when(i == 0, 1).otherwise(F.get(cuts, i - 1)["end"] + 1).cast("int"),
                        (c["start"] - F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"])).cast("int")),
            F.get(tags, c["kind"]),
        ),
    )
    rest = F.substring(text, (F.element_at(cuts, -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest))
    return keyed.select(*[(clean if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])
