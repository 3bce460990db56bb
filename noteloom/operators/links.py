"""Links between notes: extraction, resolution to notes, link graph and its upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import js_trim, parent_folder
from noteloom.runtime import BROADCAST_BYTES, BROADCAST_ROWS, checked, lookup_join, row_bytes, stage

# Targets with more than this share of all links are named in a plan, so that links are parted by them before they are made.
SETTLED_SHARE = 16_384

WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"  # fixed pattern: [[target]] or [[target|alias]]


def link_targets(text: Column | str, distinct: bool = True) -> Column:
    """Trimmed link targets in order of appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), js_trim)
    return F.array_distinct(found) if distinct else found


def wikilinks(docs: DataFrame, key: str = "path", text: str = "content", distinct: bool = True) -> DataFrame:
    """(key, pos, target): one row per link."""
    found = docs.select(key, F.posexplode_outer(link_targets(text, distinct)).alias("pos", "target"))
    return found.where(F.col("target").isNotNull())


# fixed pattern: [text](target), [text](<target>) and [text](target "title")
MARKDOWN_LINK = r"""\[[^\[\]\n]*\]\(<?([^()<>\n]+?)>?(?:\s+"[^"\n]*")?\)"""


def markdown_targets(text: Column | str) -> Column:
    """Decoded targets of Markdown links in order of appearance; links with a scheme lead out of the notes and are left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(1)), js_trim)
    inside = F.filter(found, lambda x: ~x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))
    return F.transform(inside, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))


def written_links(docs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, pos, target): one row per wiki or Markdown link, the wiki links of a text first."""
    both = F.concat(link_targets(text, False), markdown_targets(text))
    found = docs.select(key, F.posexplode_outer(both).alias("pos", "target"))
    return found.where(F.col("target").isNotNull())


def link_key(target: Column | str, subpath: bool = True) -> Column:
    """What of a target names the note: without leading ``/`` ``./`` ``../`` and ``.md``, and, if it has a ``subpath``,
    without ``#heading`` or ``#^block``."""
    target = F.col(target) if isinstance(target, str) else target
    bare = js_trim(F.substring_index(target, "#", 1)) if subpath else js_trim(target)
    return F.regexp_replace(F.regexp_replace(bare, r"^(?:\.{0,2}/)+", ""), r"(?i)\.md$", "")


def link_keys(notes: DataFrame) -> DataFrame:
    """(kind, key, hit): the best note of every name a link can use; build once, use for many :func:`resolve_links`.

    Kinds are ``path`` for whole paths and ``end`` for all their ends at folder borders, each as written and, as
    ``path/i`` and ``end/i``, in small letters. Of several notes the one with the shortest path counts, then by alphabet.
    """
    # Columns of their own, one step after the other: a lambda would work them out again for every element.
    split = notes.select("path", F.regexp_replace("path", r"(?i)\.md$", "").alias("_whole")).withColumn("_parts", F.split("_whole", "/"))
    end = lambda i: F.array_join(F.slice("_parts", i, F.size("_parts")), "/")
    cut = split.withColumn("_ends", F.transform(F.sequence(F.lit(1), F.size("_parts")), end))
    whole, ends = F.col("_whole"), F.col("_ends")
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    names = F.concat(
        F.array(one("path", whole), one("path/i", F.lower(whole))),
        F.transform(ends, lambda e: one("end", e)),
        F.transform(ends, lambda e: one("end/i", F.lower(e))),
    )
    named = cut.select("path", F.explode(names).alias("k")).select("k.*", F.struct(F.char_length("path").alias("len"), "path").alias("hit"))
    return named.groupBy("kind", "key").agg(F.min("hit").alias("hit"))


def _looked_up(asked: DataFrame, by: list[str], tries: list[tuple[int, str, Column]], keys: DataFrame) -> DataFrame:
    """(by, _hit) of the first of the ``tries`` (priority, kind, key) that names a note."""
    options = F.array(*[F.struct(F.lit(prio).alias("prio"), F.lit(kind).alias("kind"), key.alias("key")) for prio, kind, key in tries])
    names = checked(asked.select(*by, F.explode(F.array_distinct(options)).alias("o")).select(*by, "o.*"))
    found = names.join(keys, ["kind", "key"])
    return found.groupBy(*by).agg(F.min(F.struct("prio", F.col("hit.path").alias("path"))).alias("_hit"))


def _settled(answers: DataFrame) -> tuple[Column, DataFrame] | None:
    """(condition, (target, target_path)): the frequent targets whose answer is the same for all folders that ask.

    Frequent ones carry more than ``1/SETTLED_SHARE`` of all links each, so there are fewer than that. The condition holds for links
    with such a target and for no others: it names hashes that only one of all targets has. None if these targets do not
    carry half of all links, or if the links are few.
    """
    total = answers.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if total <= BROADCAST_ROWS:
        return None
    mark = F.xxhash64("target")
    found = F.struct(F.col("target_path").isNull().alias("none"), "target_path")
    by_hash = stage(
        answers.groupBy(mark.alias("_mark")).agg(
            F.sum("_n").alias("_n"), F.min("target").alias("target"), F.min("target_path").alias("target_path"),
            ((F.min("target") == F.max("target")) & (F.count("target") == F.count("*")) & (F.min(found) == F.max(found))).alias("_one"),
        )
    )
    one = by_hash.where(F.col("_one") & (F.col("_n") > total / SETTLED_SHARE))
    top = one.select("_mark", "_n", row_bytes(one).alias("size")).collect()  # fewer than SETTLED_SHARE
    if 2 * sum(r["_n"] for r in top) < total or sum(r["size"] for r in top) > BROADCAST_BYTES:
        return None
    return F.expr(f"xxhash64(target) in ({', '.join(str(r['_mark']) for r in top)})"), one.select("target", "target_path")


def resolve_links(links: DataFrame, notes: DataFrame, source: str | None = "path", keys: DataFrame | None = None) -> DataFrame:
    """Add ``target_path`` (null when unknown) to rows with ``target``.

    Order of preference: the note with that path; the note at that path below the source's folder; the note whose path
    ends with it, the shortest first. At each step the same spelling goes before another use of capitals. A target counts without leading
    dots and ``.md``; if it names no note as a whole, what follows its first ``#`` is a subpath and is left out (:func:`link_key`).
    ``keys`` are the notes' :func:`link_keys`, if they are needed more than once.

    Each target is looked up once, whatever the number of its links, and each (target, folder) once for the
    source's folder. Links with a frequent target whose answer no folder changes meet its answer by broadcast; a plain filter parts them
    from the others, so that neither part makes the other's rows. The others meet one table of answers per (target, folder).
    """
    keys = stage(link_keys(notes)) if keys is None else keys
    folder = parent_folder(source) if source else F.lit("")
    tagged = links.withColumn("_folder", folder)
    asked = stage(tagged.groupBy("target", "_folder").agg(F.count("*").alias("_n")))
    anywhere, nearby = [], []
    for step, key in ((0, link_key("target", False)), (6, link_key("target"))):
        below = F.when(key != "", F.concat("_folder", F.lit("/"), key))
        for folded in (0, 1):
            name = (lambda k: F.lower(k)) if folded else (lambda k: k)
            kind = "/i" if folded else ""
            anywhere += [(step + folded, "path" + kind, name(key)), (step + 4 + folded, "end" + kind, name(key))]
            nearby.append((step + 2 + folded, "path" + kind, name(below)))
    targets = asked.groupBy("target").agg(F.count("*").alias("_folders"))
    any_hit = _looked_up(targets, ["target", "_folders"], anywhere, keys).withColumnRenamed("_hit", "_any")
    near_hit = _looked_up(asked.where(F.col("_folder") != ""), ["target", "_folder"], nearby, keys).withColumnRenamed("_hit", "_near")
    answers = lookup_join(asked, any_hit, ["target"], weight="_folders", how="left").drop("_folders")
    answers = answers.join(near_hit.hint("merge"), ["target", "_folder"], "left").withColumn("target_path", F.least("_any", "_near")["path"])
    answers = stage(answers.select("target", "_folder", "_n", "target_path"))  # unknown ones too: a frequent unknown target meets no single task
    settled = _settled(answers)
    if settled is not None:
        tagged, answers = tagged.where(~settled[0]), answers.where(~settled[0])
    rest = lookup_join(tagged, answers, ["target", "_folder"], weight="_n", how="left").drop("_folder", "_n")
    return rest if settled is None else links.where(settled[0]).join(F.broadcast(settled[1]), "target").unionByName(rest)


def note_edges(notes: DataFrame) -> DataFrame:
    """(src, dst, n): resolved links of every note with their multiplicity."""
    return note_edges_of(written_links(notes), notes)


def note_edges_of(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Edges of written ``links`` (path, target) between ``notes`` (path)."""
    resolved = resolve_links(links, notes)
    return resolved.where(F.col("target_path").isNotNull()).groupBy(F.col("path").alias("src"), F.col("target_path").alias("dst")).agg(
        F.count("*").alias("n")
    )


def link_graph(edges: DataFrame) -> DataFrame:
    """Undirected neighbours (src, dst), each pair once per direction."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").unionByName(back).distinct()


def graph_nodes(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """All nodes; notes without any link stay nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path"))
    return ends.unionByName(sources.select("path")).distinct()


def apply_edge_changes(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Directed edges after notes changed: their outgoing links are replaced, nobody else's.

    ``changed`` (path) also holds deleted notes; edges into a deleted note disappear with
    ``deleted`` = true on it. ``fresh`` are the new outgoing edges of the changed notes.
    """
    gone = changed.where(F.col("deleted")).select(F.col("path").alias("dst")) if "deleted" in changed.columns else None
    kept = edges.join(changed.select(F.col("path").alias("src")), "src", "left_anti")
    if gone is not None:
        kept = kept.join(gone, "dst", "left_anti")
    return kept.select("src", "dst").unionByName(fresh.select("src", "dst"))
