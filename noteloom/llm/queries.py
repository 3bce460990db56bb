"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import table
from noteloom.llm.embed_dedup import near_vectors
from noteloom.llm.hard_negatives import mine_hard_negatives
from noteloom.llm.heap_clusters import clusters_with_inertia
from noteloom.llm.minhash import minhash_components
from noteloom.llm.mixing import mix
from noteloom.llm.pieces import piece_digests
from noteloom.llm.pii import find_personal_data
from noteloom.llm.quality_model import score_quality
from noteloom.llm.quality_rules import judge_quality
from noteloom.llm.substring_dedup import remove_repeats
from noteloom.llm.toxicity import score_toxicity
from noteloom.llm.url_filter import DAMPING, DISTRUST_SHARE, ROUNDS, UNITS, Rule, filter_urls
from noteloom.llm.warc import archive_pages


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op1_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base 32 of the digest: every 10 hexadecimal digits are 8 characters of 5 bits
OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex from p),
b as (select page_id, payload_bytes, array_to_string(flatten(list_transform(range(4), lambda g: list_transform(range(8),
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, g * 10 + 1, 10))::bigint >> (35 - 5 * k)) & 31)::int, 1)))), '') as payload_digest from d),
r as (select *, min(page_id) over (partition by payload_digest) as lead from b)
select page_id, payload_bytes, payload_digest, case when page_id = lead then 'response' else 'revisit' end as record_type,
  case when page_id <> lead then lead end as refers_to from r
"""


def good_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the rows that are labelled as good: the trusted target of the quality rules."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), good_rows(spark, sf_dir))


def piece_model() -> str:
    """Path of the public BPE model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), piece_model())


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return done.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(spans, ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"),
    )


# Pieces are cut with a mark after each newline or blank line and after sentences; a unit is the list of its words.
OP4_SQL = r"""
with t as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, text from documents),
b as (select doc_id, low, replace(low, chr(10), chr(10) || chr(1)) as by_line, regexp_replace(low, '(\n[\x20\x09\x0B-\x0D]*\n)', '\1' || chr(1), 'g') as by_blank from t),
cutup as (
  select doc_id, 0 as level, string_split(by_line, chr(1)) as p from b
  union all select doc_id, 1, string_split(regexp_replace(by_line, '([.!?]["'')\]]{0,2}[\x20\x09-\x0D])', '\1' || chr(1), 'g'), chr(1)) from b
  union all select doc_id, 2, string_split(by_blank, chr(1)) from b
  union all select doc_id, 3, string_split(regexp_replace(by_blank, '([.!?]["'')\]]{0,2}[\x20\x09-\x0D])', '\1' || chr(1), 'g'), chr(1)) from b),
e as (select doc_id, level, unnest(p) as piece, generate_subscripts(p, 1) as i from cutup),
o as (select *, len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) as n, sum(length(piece)) over (partition by doc_id, level order by i) - length(piece) as base from e),
c as (select doc_id, level, sum(n) over (partition by doc_id, level order by i) as upto, n,
    (base + length(piece) - length(ltrim(piece, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))::bigint as s,
    (base + length(rtrim(piece, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))::bigint as e from o where n > 0),
u as (select distinct a.doc_id, a.s, z.e, a.upto - a.n as first, z.upto as last from c a asof join c z
    on a.doc_id = z.doc_id and a.level = z.level and a.upto - a.n + 8 <= z.upto),
w as (select doc_id, regexp_extract_all(low, '[^\x20\x09-\x0D]+') as w from t),
k as (select u.doc_id, s, e, md5(array_to_string(w[(first + 1)::bigint:last::bigint], ' ')) as h from u join w on u.doc_id = w.doc_id),
r as (select *, row_number() over (partition by h order by doc_id, s) as n from k),
g as (select doc_id, s, e, case when s <= max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding)
    then 0 else 1 end as fresh from r where n > 1),
m as (select doc_id, s, e, sum(fresh) over (partition by doc_id order by s, e rows unbounded preceding) as run from g),
x as (select doc_id, run, min(s)::bigint as s, max(e)::bigint as e from m group by doc_id, run),
y as (select doc_id, count(*) as n_removed, string_agg(s || ':' || e, ',' order by s) as removed,
    list(s order by s) as ss, list(e order by s) as es from x group by doc_id)
select d.doc_id, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed, '') as removed,
  sha256(case when n_removed is null then coalesce(text, '') else
    array_to_string(list_transform(range(n_removed + 1), lambda i: substr(text,
      (case when i = 0 then 1 else es[i] + 1 end)::bigint,
      (case when i = n_removed then length(text) else ss[i + 1] end - case when i = 0 then 0 else es[i] end)::bigint)), '') end) as clean_sha256
from documents d left join y on d.doc_id = y.doc_id
"""


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
with recursive v as materialized (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as materialized (select *, sqrt(list_dot_product(e, e)) as n from v where label is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as materialized (select a.r as a, b.r as b from u a join u b on a.label = b.label and a.r <> b.r
  where case when len(a.e) = len(b.e) then list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98 else false end),
c(r, root) as (select r, vec_id from v union select l.b, c.root from c join l on l.a = c.r),
m as (select r, min(root) as root from c group by r),
n as (select a as r, count(*) as links from l group by a)
select vec_id, coalesce(links, 0)::bigint as n_links, root as component_id, vec_id is not distinct from root as kept
from v join m using (r) left join n using (r)
"""

OP10_SQL = r"""
with recursive d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select r, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from d),
x as materialized (select r, md5(unnest(s)) as h from s),
i as (select a.r as a, b.r as b, count(*) as n from x a join x b on a.h = b.h and a.r <> b.r group by all),
l as materialized (select a, b from i join s p on p.r = a join s q on q.r = b where 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
c(r, root) as (select r, doc_id from s union select l.b, c.root from c join l on l.a = c.r),
m as (select r, min(root) as root from c group by r)
select doc_id, len(s)::bigint as n_shingles, root as component_id, doc_id is not distinct from root as kept from s join m using (r)
"""


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_with_inertia(table(spark, sf_dir, "embeddings"))


def clusters_sql(rounds: int = 10) -> str:
    """Plain rounds of assignment and means; list positions are components."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    parts = [
        """with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('3:' || vec_id) nulls last, x) - 1 as c, x from v
  qualify row_number() over (order by sha256('3:' || vec_id) nulls last, x) <= 8)"""
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} as materialized (select r, min(struct_pack(d := {distance}, c := c)) as best from v cross join c{k} c group by r)""")
        if k < rounds:
            parts.append(f"""s{k} as (select best.c as c, i, sum(x[i])::hugeint as s, count(*) as n from a{k} join v using (r), range(1, 65) t(i) group by best.c, i),
m{k} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from s{k} group by c),
c{k + 1} as materialized (select c{k}.c as c, coalesce(m{k}.x, c{k}.x) as x from c{k} left join m{k} on c{k}.c = m{k}.c)""")
    return ",\n".join(parts) + f"""
select vec_id, best.c::int as cluster, best.d as distance, sum(best.d) over (partition by best.c)::bigint as cluster_inertia,
  sum(best.d) over ()::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} join v using (r) join c{rounds} c on c.c = best.c"""


RULES = [
    Rule(True, "com", "/"),
    Rule(False, "example.com", "/en/"),
    Rule(True, "www.example.com", "/en/"),
    Rule(False, "net", "/es/"),
    Rule(False, "net", "/fr/"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def urls_sql(rounds: int = ROUNDS) -> str:
    """The rules as one CASE, the two ranks as one table per round."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    after = lambda u: f"(case when contains({u}, '://') then substr({u}, instr({u}, '://') + 3) else '' end)"
    host = lambda u: f"translate(regexp_extract({after(u)}, '^[^/?#]*'), {letters})"
    longest = sorted(RULES, key=lambda r: -len(r.text))
    fits = " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.text}'" for r in longest)
    allowed = ", ".join(f"'{r.text}'" for r in RULES if r.allow)
    parts = [
        f"""with h as (select page_id, html, coalesce({host("url")}, '') as host,
  coalesce(regexp_extract(regexp_extract({after("url")}, '^[^?#]*'), '^[^/]*(/.*)?$', 1, 's'), '') as path from pages),
p as materialized (select *, rule in ({allowed}) as allow from (select *, case {fits} end as rule from h)),
hosts as materialized (select host, sum(case when allow then 1 when not allow then -1 else 0 end) as votes from p where host <> '' group by host),
n as (select greatest(count(*) filter (votes > 0), 1) as good, greatest(count(*) filter (votes < 0), 1) as bad from hosts),
r0 as materialized (select case when votes > 0 then 'trust' else 'distrust' end as kind, host,
  round(round({float(UNITS)}::double / case when votes > 0 then good else bad end)::bigint * (1 - {DAMPING}::double))::bigint as mass
  from hosts, n where votes <> 0),
found as (select page_id, host as src, unnest(regexp_extract_all(html,
  '(?i)(?:href|src|action)\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s<>]+)', 1)) as link, row_number() over () as r from p),
targets as (select distinct r, src, {host("case when starts_with(link, '//') then ':' || link else link end")} as dst
  from (select page_id, src, link, r from found)),
links as (select src, dst, count(*) as n from targets where src <> '' and dst <> '' and src <> dst group by src, dst),
edges as materialized (select 'trust' as kind, src, dst, n from links union all select 'distrust', dst, src, n from links),
totals as (select kind, src, sum(n) as total from edges group by kind, src)"""
    ]
    for k in range(1, rounds + 1):
        parts.append(f"""r{k} as materialized (select kind, host, sum(mass)::bigint as mass from (select * from r0 union all
  select e.kind, e.dst, round((r.mass * {DAMPING}::double / total) * e.n)::bigint from edges e
  join totals t on t.kind = e.kind and t.src = e.src join r{k - 1} r on r.kind = e.kind and r.host = e.src) group by kind, host)""")
    return ",\n".join(parts) + f""",
scores as (select host, coalesce(sum(mass) filter (kind = 'trust'), 0)::bigint as trust, coalesce(sum(mass) filter (kind = 'distrust'), 0)::bigint as distrust
  from r{rounds} group by host)
select page_id, p.host as host, path, rule, case when coalesce(allow, not (distrust > 0 and distrust >= {DISTRUST_SHARE}::double * (trust + distrust)), true)
  then 'allow' else 'block' end as verdict, coalesce(trust, 0)::bigint as trust, coalesce(distrust, 0)::bigint as distrust
from p left join scores s on s.host = p.host"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as materialized (select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same,
  list_sum(list_transform(list_zip(a.x, v.x), lambda p: p[1] * p[2]))::bigint as score
  from v a join v on a.vec_id <> v.vec_id and len(a.x) = len(v.x) where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""


QUERIES = {f.__name__: f for f in (op1_warc_from_arc, op2_quality_rules, op3_sentencepiece, op4_repeated_passages, op5_source_mixing, op6_embedding_near_dedup, op7_personal_data, op8_quality_classifier, op9_toxicity, op10_minhash_near_dedup, op11_heap_clusters, op12_url_filter, op13_hard_negatives)}
ORACLES: dict[str, str] = {
    "op1_warc_from_arc": OP1_SQL,
    "op4_repeated_passages": OP4_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op11_heap_clusters": clusters_sql(),
    "op12_url_filter": urls_sql(),
    "op13_hard_negatives": OP13_SQL,
}
