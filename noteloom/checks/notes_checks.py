"""Registered queries: sources, text functions, parsing, chunking, links, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.checks import sqltext as S
from noteloom.checks import tables as X
from noteloom.functions import text as t
from noteloom.operators import chunking, frontmatter, links, listing
from noteloom.sources import notes as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
DOC_NOTES = "doc_notes as (select source || '/' || doc_id || '.md' as path, doc_id::varchar as name, text as content, * from documents)"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


# --- sources ---------------------------------------------------------------------------------


@query("select source || '/' || doc_id || '.md' as path, doc_id::varchar as name, 'md' as ext, strlen(text)::bigint as size, sha256(text) as hash from documents")
def scan_notes(spark, sf):
    return src.markdown_only(X.document_notes(spark, sf)).select("path", "name", "ext", "size", t.content_hash("content").alias("hash"))


@query(f"{S.WITH_NOTES} select path, basename as name, strlen(content)::bigint as size from notes where starts_with(path, 'ASIA/')")
def scan_folder(spark, sf):
    return src.in_folder(X.notes(spark, sf), "ASIA").select("path", "name", "size")


@query(
    f"{S.WITH_NOTES}, req as (select doc_id, case when quality = 1 then (select min(r_name) from region) || '/' || doc_id || '.md' "
    "else 'ASIA.md' end as path from labels) "
    "select req.doc_id, req.path, n.basename as name, n.content, case when n.path is null then 'missing' else 'found' end as status "
    "from req left join notes n on n.path = req.path"
)
def read_by_path(spark, sf):
    first = X.table(spark, sf, "region").agg(F.min("r_name").alias("r")).scalar()
    path = F.when(F.col("quality") == 1, F.concat(first, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise("ASIA.md")
    requests = X.table(spark, sf, "labels").select("doc_id", path.alias("path"))
    return src.read_by_path(requests, X.notes(spark, sf))


@query(f"{S.WITH_NOTES} select path, epoch_us(mtime)::bigint as mtime_us from notes order by mtime desc, path limit 200")
def recent_notes(spark, sf):
    return src.recent_paths(X.notes(spark, sf), 200).select("path", t.epoch_micros("mtime").alias("mtime_us"))


@query(
    f"""{S.WITH_NOTES}, new as (select path, content || chr(10) || 'edited' as content from notes where starts_with(path, 'EUROPE/')
    union all select 'Inbox/' || n_name || '.md', '# ' || n_name from nation)
    select path, sha256(content) as hash from new
    union all select path, sha256(content) from notes where path not in (select path from new)"""
)
def upsert_notes(spark, sf):
    stored = X.stored_notes(spark, sf)
    notes = stored.select("path", "content")
    edited = src.in_folder(stored, "EUROPE").select("path", "content")
    created = X.table(spark, sf, "nation").select(
        F.concat(F.lit("Inbox/"), "n_name", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "n_name").alias("content")
    )
    updates = (
        edited.withColumn("seq", F.lit(1))
        .unionByName(edited.select("path", F.concat("content", F.lit("\nedited")).alias("content"), F.lit(2).alias("seq")))
        .unionByName(created.withColumn("seq", F.lit(1)))
    )
    return src.upsert_notes(notes, updates).select("path", t.content_hash("content").alias("hash"))


@query("select source || '/' || doc_id || '.md' as path from documents where source not in ('src1', 'src11')")
def exclude_folders(spark, sf):
    return X.document_notes(spark, sf).where(src.not_excluded(F.col("path"), " src1, ,src11")).select("path")


# --- scalar functions ------------------------------------------------------------------------


@query(f"{S.WITH_NOTES}, x as (select path as id, content as s from notes union all select doc_id::varchar, text from documents) select id, {S.est_tokens('s')} as tokens from x")
def estimate_tokens(spark, sf):
    rows = X.notes(spark, sf).select(F.col("path").alias("id"), F.col("content").alias("s"))
    docs = X.document_notes(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.col("content").alias("s"))
    return rows.unionByName(docs).select("id", t.estimate_tokens("s").cast("long").alias("tokens"))


@query(f"{S.WITH_NOTES}, x as (select path as id, content as s from notes union all select doc_id::varchar, text from documents), y as (select id, {S.tokens('s')} as tk from x) select id, len(tk)::bigint as n, array_to_string(tk, ' ') as tokens from y")
def tokenize(spark, sf):
    rows = X.notes(spark, sf).select(F.col("path").alias("id"), F.col("content").alias("s"))
    docs = X.document_notes(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.col("content").alias("s"))
    tk = rows.unionByName(docs).select("id", t.tokenize("s").alias("tk"))
    return tk.select("id", F.size("tk").cast("long").alias("n"), F.array_join("tk", " ").alias("tokens"))


@query("select doc_id, sha256(text) as hash from documents")
def content_hash(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", t.content_hash("text").alias("hash"))


@query(
    f"{S.WITH_NOTES}, x as (select path as p from notes union all select url from pages) "
    "select p as path, regexp_replace(regexp_extract(p, '[^/]*$', 0), '\\.[^.]*$', '') as basename, "
    "case when contains(p, '/') then regexp_replace(p, '/[^/]*$', '') else '' end as folder, "
    "case when contains(p, '/') then len(string_split(regexp_replace(p, '/[^/]*$', ''), '/')) else 0 end::bigint as depth from x"
)
def path_parts(spark, sf):
    x = X.notes(spark, sf).select("path").unionByName(X.table(spark, sf, "pages").select(F.col("url").alias("path")))
    return x.select(
        "path",
        t.base_name("path").alias("basename"),
        t.parent_folder("path").alias("folder"),
        F.size(t.folder_segments("path")).cast("long").alias("depth"),
    )


@query(
    f"""select o_orderkey, case when k < 1000 then k::varchar when k < 10000 then {S.fixed_digits('k / 1000', 1)} || 'K'
      else floor(k / 1000 + 0.5)::bigint || 'K' end as token_label, {S.bytes_label('s')} as size_label,
      strftime(o_orderdate, '%Y-%m-%d %H:%M') as minute_label,
      month(o_orderdate) || '/' || day(o_orderdate) || strftime(o_orderdate, ' %H:%M') as date_label
    from (select *, o_totalprice::bigint as k, floor(o_totalprice * 40)::bigint as s from orders)"""
)
def format_labels(spark, sf):
    o = X.table(spark, sf, "orders").withColumn("k", F.round("o_totalprice").cast("long")).withColumn("s", F.floor(F.col("o_totalprice") * 40))
    return o.select(
        "o_orderkey",
        t.token_label("k").alias("token_label"),
        t.bytes_label("s").alias("size_label"),
        t.minute_label("o_orderdate").alias("minute_label"),
        t.short_date_label("o_orderdate").alias("date_label"),
    )


# --- parsing and chunking --------------------------------------------------------------------

_FM_SQL = f"""{S.WITH_NOTES}, {S.fm_ctes()},
l0 as (select path, unnest(string_split(block, chr(10))) as raw, generate_subscripts(string_split(block, chr(10)), 1) as i from fm where e > 0),
l1 as (select path, i, {S.trim('raw')} as l from l0 where {S.trim('raw')} <> '' and not starts_with({S.trim('raw')}, '#')),
l2 as (select *, strpos(l, ':') > 1 and not starts_with(l, '- ') as is_key from l1),
l3 as (select *, sum(is_key::int) over (partition by path order by i) as k from l2),
keys as (select path, k, {S.trim("substr(l, 1, strpos(l, ':') - 1)")} as key, {S.trim("substr(l, strpos(l, ':') + 1)")} as v from l3 where is_key),
items as (select path, k, row_number() over (partition by path, k order by i) - 1 as pos, {S.trim('substr(l, 3)')} as value from l3 where not is_key and starts_with(l, '- ')),
flat as (
 select path, key, false as is_list, 0::bigint as pos, regexp_replace(v, '^["'']|["'']$', '', 'g') as value from keys where v not in ('', '[]') and not (starts_with(v, '[') and v like '%]')
 union all select path, key, true, generate_subscripts(vs, 1) - 1, unnest(vs) from (select path, key, list_filter(list_transform(string_split(substr(v, 2, length(v) - 2), ','), lambda p: regexp_replace({S.trim('p')}, '^["'']|["'']$', '', 'g')), lambda p: p <> '') as vs from keys where v <> '[]' and starts_with(v, '[') and v like '%]')
 union all select path, key, true, i.pos, i.value from keys join items i using (path, k) where v in ('', '[]'))
select fm.path, fm.base::bigint as body_start_line, length(fm.body)::bigint as body_chars, f.key, f.is_list, f.pos::bigint as pos, f.value from fm left join flat f using (path)"""


@query(_FM_SQL)
def frontmatter_split(spark, sf):
    notes = X.notes(spark, sf)
    parsed = frontmatter.with_frontmatter(notes)
    rows = parsed.select(
        "path",
        F.col("body_start_line").cast("long").alias("body_start_line"),
        F.char_length("body").cast("long").alias("body_chars"),
        "metadata_is_list",
        F.explode_outer("metadata").alias("key", "vals"),
    )
    return rows.select(
        "path",
        "body_start_line",
        "body_chars",
        "key",
        F.element_at("metadata_is_list", F.col("key")).alias("is_list"),
        F.posexplode_outer("vals").alias("pos", "value"),
    ).withColumn("pos", F.col("pos").cast("long"))


QUERIES["frontmatter"] = QUERIES.pop("frontmatter_split")
SQL["frontmatter"] = SQL.pop("frontmatter_split")


def _chunk_rows(df):
    return df.select(
        "path",
        F.col("c.content").alias("content"),
        F.col("c.heading").alias("heading"),
        F.col("c.start_line").cast("long").alias("start_line"),
        F.col("c.end_line").cast("long").alias("end_line"),
    )


def _raw(notes, strategy, max_tokens=512):
    split = chunking.raw_chunks(frontmatter.with_frontmatter(notes.select("path", "name", "content")), strategy, max_tokens)
    return split.select("path", F.explode_outer("raw").alias("c")).where(F.col("c").isNotNull())


_SECTION_CTES = f"""{S.fm_ctes()}, {S.line_ctes()},
s0 as (select *, sum(is_heading::int) over (partition by path order by i) as sec from ln),
raw as (select path, base, sec, {S.trim("string_agg(line, chr(10) order by i)")} as content,
  max(case when is_heading then heading_text end) as heading, min(i) + base as start_line, max(i) + base as end_line
  from s0 group by path, base, sec)"""


@query(f"{S.WITH_NOTES}, {_SECTION_CTES} select path, content, heading, start_line::bigint as start_line, end_line::bigint as end_line from raw where content <> ''")
def chunk_section(spark, sf):
    return _chunk_rows(_raw(X.notes(spark, sf), "section"))


@query(
    f"""{S.WITH_NOTES}, {S.fm_ctes()}, {S.line_ctes()},
    p0 as (select *, sum(gap::int) over (partition by path order by i) as para,
      last_value(case when is_heading then heading_text end ignore nulls) over (partition by path order by i) as h from ln),
    p1 as (select path, para, base, {S.trim("string_agg(line, chr(10) order by i)")} as content, min(i) as s, max(i) as e
      from p0 where not gap group by path, para, base),
    closing as (select path, i, h from p0)
    select p1.path, p1.content, closing.h as heading, (p1.s + p1.base)::bigint as start_line, (p1.e + p1.base)::bigint as end_line
    from p1 join closing on closing.path = p1.path and closing.i = p1.e where p1.content <> ''"""
)
def chunk_paragraph(spark, sf):
    return _chunk_rows(_raw(X.notes(spark, sf), "paragraph"))


def _fixed_sql(max_tokens: int, ctes: str, lines: str) -> str:
    """Greedy packing as a recursive walk over lines; ``lines`` has key, i, line, cost, n."""
    return f"""{ctes},
    walk as (select k, i, cost as used, 0::bigint as chunk, 1 as held from {lines} where i = 0
      union all select l.k, l.i, case when w.used + l.cost > {max_tokens} and l.code = 0 then l.cost else w.used + l.cost end,
        case when w.used + l.cost > {max_tokens} and l.code = 0 then w.chunk + 1 else w.chunk end, 1
      from walk w join {lines} l on l.k = w.k and l.i = w.i + 1)"""


_DOC_LINES = f"""with recursive {DOC_NOTES},
dl0 as (select path as k, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as i from doc_notes where {S.trim('content')} <> ''),
dl as materialized (select *, {S.est_tokens('line')} as cost, 0 as code from dl0)"""


@query(
    _fixed_sql(128, _DOC_LINES, "dl")
    + f""", packed as (select k, chunk, {S.trim("string_agg(line, chr(10) order by i)")} as content, min(i) as s, max(i) as e from walk join dl using (k, i) group by k, chunk)
    select k as path, content, null::varchar as heading, s::bigint as start_line, e::bigint as end_line from packed where content <> ''"""
)
def chunk_fixed(spark, sf):
    return _chunk_rows(_raw(X.document_notes(spark, sf), "fixed", 128))


_RESPLIT_LINES = f"""with recursive {DOC_NOTES},
big as (select path, {S.trim('content')} as body, len(string_split(content, chr(10))) - 1 as last_line from doc_notes where {S.est_tokens(S.trim('content'))} > 256),
dl0 as (select path as k, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) - 1 as i from big),
dl as materialized (select *, {S.est_tokens('line')} as cost, 0 as code from dl0)"""


@query(
    _fixed_sql(256, _RESPLIT_LINES, "dl")
    + f""", packed as (select k, chunk, {S.trim("string_agg(line, chr(10) order by i)")} as content, min(i) as s, max(i) as e from walk join dl using (k, i) group by k, chunk),
    marked as (select *, chunk = max(chunk) over (partition by k) as is_last from packed)
    select k as path, content, s::bigint as start_line, (case when is_last then last_line else e end)::bigint as end_line
    from marked join big on big.path = k where content <> ''"""
)
def chunk_resplit(spark, sf):
    """Documents over 256 tokens, cut at line ends."""
    one = F.struct(
        t.js_trim("content").alias("content"),
        F.lit(None).cast("string").alias("heading"),
        F.lit(0).alias("start_line"),
        (F.size(F.split("content", "\n", -1)) - 1).alias("end_line"),
    )
    big = X.document_notes(spark, sf).where(t.estimate_tokens(t.js_trim("content")) > 256).withColumn("one", one)
    cut = big.select("path", F.explode_outer(chunking.split_large(F.col("one"), 256)).alias("c")).where(F.col("c").isNotNull())
    return _chunk_rows(cut).drop("heading")


@query(
    f"""{S.WITH_NOTES}, {_SECTION_CTES}, ok as (select *, row_number() over (partition by path order by start_line) - 1 as n from raw where content <> '')
    select path || '::' || n as chunk_id, path, regexp_extract(path, '([^/]*)\\.md$', 1) as name, n::bigint as chunk_index, content, heading,
      start_line::bigint as start_line, end_line::bigint as end_line, {S.est_tokens('content')} as tokens from ok"""
)
def chunk_documents(spark, sf):
    c = chunking.chunk_documents(X.notes(spark, sf), "section", 512)
    return c.select(
        "chunk_id",
        "path",
        "name",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "content",
        "heading",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        F.col("tokens").cast("long").alias("tokens"),
    )


# --- links -----------------------------------------------------------------------------------

LINK_CTES = rf"""lk0 as (select path, list_transform(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1), lambda x: {S.trim('x')}) as ts from notes),
lk as (select path, unnest(ts) as target, generate_subscripts(ts, 1) - 1 as pos from lk0),
res as (select lk.*, coalesce(a.path, b.path,
   (select min(n.path) from notes n where n.basename = lk.target and regexp_replace(n.path, '/?[^/]*$', '') = regexp_replace(lk.path, '/?[^/]*$', '')),
   (select arg_min(n.path, struct_pack(l := length(n.path), p := n.path)) from notes n where n.basename = lk.target)) as target_path
  from lk left join notes a on a.path = lk.target left join notes b on b.path = lk.target || '.md'),
edges as (select path as src, target_path as dst, count(*)::bigint as n from res where target_path is not null group by all),
graph as (select src, dst from edges union select dst, src from edges)"""


@query(f"{S.WITH_NOTES}, {LINK_CTES} select path, target, min(pos)::bigint as first_pos from lk group by path, target")
def wikilinks(spark, sf):
    notes = X.stored_notes(spark, sf)
    every = links.wikilinks(notes, distinct=False)
    unique = links.wikilinks(notes).select("path", "target")
    return every.join(unique, ["path", "target"], "left_semi").groupBy("path", "target").agg(F.min("pos").cast("long").alias("first_pos"))


@query(f"{S.WITH_NOTES}, {LINK_CTES} select path, pos::bigint as pos, target, target_path from res")
def resolve_links(spark, sf):
    notes = X.stored_notes(spark, sf)
    return links.resolve_links(links.wikilinks(notes, distinct=False), notes).select("path", F.col("pos").cast("long").alias("pos"), "target", "target_path")


# links of every customer's note to its nation, its peer and itself, in many spellings
_FORMS = """select a.path, 0 as form, concat(n_name, '#Profile') as target from {notes} a join {customer} on c_name = a.basename join {nation} on n_nationkey = c_nationkey
union all select a.path, 1, upper(c_name) from {notes} a join {customer} on c_name = a.basename
union all select a.path, 2, concat(lower(n_name), '/', c_name, '.md') from {notes} a join {customer} on c_name = a.basename join {nation} on n_nationkey = c_nationkey
union all select a.path, 3, concat('../../', r_name, '.MD#^b1') from {notes} a join {customer} on c_name = a.basename join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey
union all select a.path, 4, concat('./', c_name) from {notes} a join {customer} on c_custkey % 100 = 1 where a.path like '%/NATION_1%'
union all select a.path, 5, '#Profile' from {notes} a union all select a.path, 6, concat('no/', a.basename) from {notes} a"""


@query(
    rf"""{S.WITH_NOTES}, l as ({_FORMS.format(notes="notes", customer="customer", nation="nation", region="region")}),
    k as (select *, regexp_replace(regexp_replace(cut, '^(\.{{0,2}}/)+', ''), '\.[mM][dD]$', '') as key, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder
      from (select *, 0 as step, target as cut from l union all select *, 6, split_part(target, '#', 1) from l)),
    m as (select path as hit, regexp_replace(path, '\.md$', '') as whole, length(path) as len from notes),
    e as (select hit, len, unnest(list_transform(range(1, len(string_split(whole, '/')) + 1), lambda i: array_to_string(string_split(whole, '/')[i:], '/'))) as ending, whole from m),
    t as (select path, form, target, hit, len, step + case when whole = key then 0 else 1 end as prio from k join m on lower(whole) = lower(key)
      union all select path, form, target, hit, len, step + case when whole = folder || '/' || key then 2 else 3 end from k join m on folder <> '' and key <> '' and lower(whole) = lower(folder || '/' || key)
      union all select path, form, target, hit, len, step + case when ending = key then 4 else 5 end from k join e on lower(ending) = lower(key)),
    best as (select path, form, target, arg_min(hit, struct_pack(p := prio, l := len, h := hit)) as target_path from t group by all)
    select path, form::bigint as form, target, target_path from l left join best using (path, form, target)"""
)
def resolve_link_forms(spark, sf):
    """Subpaths, capitals, ends of paths, relative and broken links."""
    notes = X.stored_notes(spark, sf)
    forms = spark.sql(_FORMS, notes=notes, **{n: X.table(spark, sf, n) for n in ("customer", "nation", "region")})
    found = links.resolve_links(forms, notes)
    return found.select("path", F.col("form").cast("long").alias("form"), "target", "target_path")


@query(f"{S.WITH_NOTES}, {LINK_CTES} select src, dst from graph union all select path, null from notes where path not in (select src from graph)")
def link_graph(spark, sf):
    notes = X.stored_notes(spark, sf)
    graph = links.link_graph(links.note_edges(notes))
    return links.graph_nodes(graph, notes).select(F.col("path").alias("src")).join(graph, "src", "left")


@query(
    f"""{S.WITH_NOTES}, {LINK_CTES}, changed as (select path, path not like '%/%' as deleted from notes where path not like '%/%' or starts_with(path, 'AFRICA/')),
    fresh as (select c.path as src, 'ASIA.md' as dst from changed c where not deleted),
    kept as (select src, dst from edges where src not in (select path from changed) and dst not in (select path from changed where deleted)),
    now as (select src, dst from kept union select src, dst from fresh)
    select src, dst from now union select dst, src from now"""
)
def link_graph_delta(spark, sf):
    """Root notes are deleted; every note below AFRICA now links to ASIA.md only."""
    notes = X.stored_notes(spark, sf)
    is_root = ~F.contains(F.col("path"), F.lit("/"))
    changed = notes.where(is_root | F.startswith("path", F.lit("AFRICA/"))).select("path", is_root.alias("deleted"))
    fresh = changed.where(~F.col("deleted")).select(F.col("path").alias("src"), F.lit("ASIA.md").alias("dst"))
    return links.link_graph(links.apply_edge_changes(links.note_edges(notes), changed, fresh))


# --- listings --------------------------------------------------------------------------------

FOLDERS_SQL = """fl as (select r_name as path from region where exists (select 1 from nation where n_regionkey = r_regionkey)
  union all select r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey
    where exists (select 1 from customer where c_nationkey = n_nationkey)),
folders as (select f.path, regexp_extract(f.path, '[^/]*$', 0) as name, regexp_replace(f.path, '/?[^/]*$', '') as parent,
  (select count(*) from notes n where regexp_replace(n.path, '/?[^/]*$', '') = f.path)
  + (select count(*) from fl g where regexp_replace(g.path, '/?[^/]*$', '') = f.path) as children from fl f)"""


@query(f"{S.WITH_NOTES}, {FOLDERS_SQL} select path, name, parent, children::bigint as children from folders")
def folder_entries(spark, sf):
    return listing.folder_entries(X.stored_notes(spark, sf))


_ENTRIES_SQL = f"""{S.WITH_NOTES}, {FOLDERS_SQL},
entries as (select path, basename || '.md' as name, 'file' as type, strlen(content)::bigint as size, mtime, null::bigint as children from notes where starts_with(path, 'ASIA/')
 union all select path, name, 'folder', 0, null, children::bigint from folders where starts_with(path, 'ASIA/')),
page as (select *, row_number() over (order by mtime desc nulls last, path) as position from entries)"""


@query(
    f"""{_ENTRIES_SQL} select path, name, type, size, epoch_us(mtime)::bigint as mtime_us, children, (select count(*) from entries)::bigint as total,
    110 < (select count(*) from entries) as has_more from page where position between 11 and 110"""
)
def list_notes(spark, sf):
    page = listing.list_notes(X.stored_notes(spark, sf), "mtime", limit=100, offset=10, folder="ASIA", include_folders=True)
    return page.select("path", "name", "type", "size", t.epoch_micros("mtime").alias("mtime_us"), "children", "total", "has_more")


@query(
    f"""{_ENTRIES_SQL} select 'Found ' || (select count(*) from entries) || ' items total. Showing ' || count(*) || ' items.'
     || case when 110 < (select count(*) from entries) then ' (use offset for more)' else '' end || chr(10) || chr(10)
     || 'Path | Type | Size | Modified' || chr(10) || '---|---|---|---' || chr(10)
     || string_agg(path || ' | ' || type || ' | ' || case when type = 'folder' then children || ' items' else {S.bytes_label('size')} end
        || ' | ' || coalesce(strftime(mtime, '%Y-%m-%d %H:%M'), '-'), chr(10) order by position) as report
    from page where position between 11 and 110"""
)
def list_report(spark, sf):
    return listing.list_report(X.stored_notes(spark, sf), "mtime", limit=100, offset=10, folder="ASIA", include_folders=True)


@query(
    f"""{S.WITH_NOTES}, page as (select *, row_number() over (order by mtime desc, path) as pos from notes)
    select 'path | size | mtime' || chr(10) || '--- | --- | ---' || chr(10)
     || string_agg('[[' || path || ']] | ' || strlen(content) || ' | ' || strftime(mtime, '%Y-%m-%d'), chr(10) order by pos)
     || case when (select count(*) from notes) > 200 then chr(10) || '... and ' || ((select count(*) from notes) - 200) || ' more rows' else '' end as text
    from page where pos <= 200"""
)
def render_table(spark, sf):
    return listing.render_table(X.stored_notes(spark, sf), ["path", "size", "mtime"], [("mtime", "desc"), ("path", "asc")], links=["path"], cap=200)


# --- ad-hoc queries over the note views ------------------------------------------------------


@query("select 'customer' as tag, count(*)::bigint as n from customer union all select lower(c_mktsegment), count(*) from customer group by 1")
def tag_counts(spark, sf):
    from noteloom.plans.views import note_views

    v = note_views(X.stored_notes(spark, sf))
    return spark.sql("select tag, count(*) as n from {tags} group by tag", tags=v["tags"])


@query(f"{S.WITH_NOTES} select path, epoch_us(mtime)::bigint as mtime_us from notes where content like '%status: \"active\"%' and content like '%tags: [building,%'")
def metadata_filter(spark, sf):
    from noteloom.plans.views import note_views

    v = note_views(X.stored_notes(spark, sf))
    found = spark.sql(
        "select n.path, n.mtime from {notes} n left semi join (select * from {metadata} where key = 'status' and value = 'active') s on n.path = s.path "
        "left semi join (select * from {tags} where tag = 'building') t on n.path = t.path",
        notes=v["notes"],
        metadata=v["metadata"],
        tags=v["tags"],
    )
    return found.select("path", t.epoch_micros("mtime").alias("mtime_us"))
