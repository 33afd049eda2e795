"""Registered queries of the search, usage, journal, content and view operators, with the SQL that must give the same rows.

All run over the whole volume of the tables raw_record, size_row and volume_info; its entries are built once for a session
and folder.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .functions import highlight
from .functions import text as X
from .operators import content, journal, usage, view
from .operators import volume as V
from .plans import front
from .runtime import read_table
from .sources import snapshot
from .sources.volumes import ParquetVolume
from .streaming import journal as streaming

_BUILT: dict[tuple[str, str], V.Volume] = {}
EXCLUDES = ["cache", "\\users\\"]
RULES = [view.Rule("c:\\*\\", True), view.Rule("c:\\users\\", False), view.Rule("c:\\users\\import*\\", True), view.Rule("*\\lab\\", False)]


def volume_of(spark: SparkSession, d: str) -> V.Volume:
    """The volume of a folder's tables, built once for an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        source = ParquetVolume(spark, d)
        _BUILT[key] = V.build_entries(source.records(), source.sizes(), source.drive, source.cluster_bytes, source.root_frn)
    return _BUILT[key]


def _find(text: str, spark: SparkSession, d: str, **options) -> DataFrame:
    return V.search(volume_of(spark, d), text, **options)[0].select("id", "path")


def _rank(text: str, limit: int, reserve: int, spark: SparkSession, d: str) -> DataFrame:
    hits, query = V.search(volume_of(spark, d), text)
    return V.top_ranked(hits, query, limit, reserve).select(F.col("rank_pos").cast("long").alias("rank_pos"), "id", "path")


_VOL = r"""WITH RECURSIVE
rec AS (SELECT DISTINCT ord AS id, frn, parent_frn, coalesce(name_utf16, '') AS name, coalesce(attributes, 0) AS attributes FROM raw_record WHERE ord IS NOT NULL AND frn IS NOT NULL),
one AS (SELECT root_frn, cluster_bytes, (SELECT max(id) + 1 FROM rec) AS root_id FROM volume_info),
canon AS (SELECT frn, max(id) AS canon FROM rec GROUP BY frn),
sz AS (SELECT frn, max(struct_pack(c := clusters, t := truncated)) AS s FROM size_row GROUP BY frn),
szi AS (SELECT canon AS id, s FROM canon JOIN sz USING (frn)),
lk AS MATERIALIZED (SELECT r.id, r.frn, r.name, r.attributes, CASE WHEN r.parent_frn = root_frn THEN root_id WHEN c.canon <> r.id THEN c.canon END AS parent_id,
    szi.id IS NOT NULL AS sized, coalesce(szi.s.c, 0) AS clusters, coalesce(szi.s.t, FALSE) AS size_truncated
  FROM rec r CROSS JOIN one LEFT JOIN canon c ON c.frn = r.parent_frn LEFT JOIN szi ON szi.id = r.id),
tr AS (SELECT id, id AS top, 0 AS depth, CASE WHEN parent_id IS NULL THEN '<orphan>' ELSE 'C:' END || chr(92) || name AS path, parent_id IS NULL AS is_orphan FROM lk, one WHERE parent_id IS NULL OR parent_id = root_id
  UNION ALL SELECT lk.id, tr.top, tr.depth + 1, tr.path || chr(92) || lk.name, tr.is_orphan FROM lk JOIN tr ON lk.parent_id = tr.id),
v AS MATERIALIZED (SELECT lk.*, lower(translate(lk.name, 'Σ', 'σ')) AS name_fold, (attributes & 16) <> 0 AS is_dir, (attributes & 1024) <> 0 AS is_reparse, tr.depth,
    coalesce(tr.path, '<orphan>' || chr(92) || lk.name) AS path, coalesce(tr.is_orphan, TRUE) AS is_orphan, lower(translate(coalesce(tr.path, '<orphan>' || chr(92) || lk.name), 'Σ', 'σ')) AS path_fold,
    coalesce(parent_id = root_id, FALSE) AS at_root, clusters * cluster_bytes AS size_bytes, root_id, cluster_bytes FROM lk CROSS JOIN one LEFT JOIN tr ON tr.id = lk.id),
ex AS (SELECT id, coalesce(regexp_extract(name_fold, '(?s)\.([^.]+)\z', 1), '') AS ext FROM v),
kids AS (SELECT parent_id AS id, count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS dirs FROM v WHERE parent_id IS NOT NULL GROUP BY parent_id)
"""
_FROM = "FROM v JOIN ex USING (id) LEFT JOIN kids k USING (id)"


def _where(cond: str, orphans: str = "NOT is_orphan") -> str:
    return f"{_VOL} SELECT v.id, v.path {_FROM} WHERE {orphans} AND ({cond})"


_BS = "chr(92)"
# name: (query text, condition in SQL)
_SEARCHES: dict[str, tuple[str, str]] = {
    "name_contains": ("report", "contains(name_fold, 'report')"),
    "name_contains_quoted": ('"final 5"', "contains(name_fold, 'final 5')"),
    "name_and": ("report final", "contains(name_fold, 'report') AND contains(name_fold, 'final')"),
    "name_whole": ("wfn:readme.md", "name_fold = 'readme.md'"),
    "name_prefix": ("startwith:lib", "starts_with(name_fold, 'lib')"),
    "name_suffix": ("endwith:.tar.gz", "suffix(name_fold, '.tar.gz')"),
    "name_word": ("ww:final", r"regexp_matches(name_fold, '(^|[^0-9a-z_\x{80}-\x{10FFFF}])final($|[^0-9a-z_\x{80}-\x{10FFFF}])')"),
    "name_glob": ("*re?ort*.m?", r"regexp_full_match(name_fold, '(?s).*re.ort.*\.m.')"),
    "name_nowildcards": ("nowildcards:v3", "contains(name_fold, 'v3')"),
    "name_case": ("case:README", "contains(name, 'README')"),
    "name_regex": (r'regex:"^[a-m].*\d{4}\.(log|txt)$"', r"regexp_matches(name, '(?i)^[a-m].*\p{Nd}{4}\.(log|txt)$')"),
    "name_regex_case": (r"case:regex:^[A-M]\w+$", r"regexp_matches(name, '^[A-M][\pL\pN\pM_\x{200c}\x{200d}]+$')"),
    "path_contains": ("path:users", "contains(path_fold, 'users')"),
    "path_joined": (r"users\import", f"contains(path_fold, 'users' || {_BS} || 'import')"),
    "path_slash": ("path:users/import", f"contains(path_fold, 'users' || {_BS} || 'import')"),
    "path_prefix": (r"path:startwith:c:\lab" "\\", f"starts_with(path_fold, 'c:' || {_BS} || 'lab' || {_BS})"),
    "path_glob": (r"path:*\lab\*.log", r"regexp_full_match(path_fold, '(?s).*\\lab\\.*\.log')"),
    "path_regex": (r'pathregex:"\\lab\\.*\.(log|txt)$"', r"regexp_matches(path, '(?i)\\lab\\.*\.(log|txt)$')"),
    "path_case": ("case:path:Users", "contains(path, 'Users')"),
    "ext_in": ("ext:rs;.toml", "ext IN ('rs', 'toml')"),
    "type_group": ("pic:report", "ext IN ('ani','avif','bmp','dds','gif','heic','heif','ico','jfif','jpe','jpeg','jpg','jxl','pcx','png','psd','raw','svg','tga','tif','tiff','webp','wmf') AND contains(name_fold, 'report')"),
    "kind_file": ("file:*.dll", "NOT is_dir AND suffix(name_fold, '.dll')"),
    "kind_folder": ("folder:src", "is_dir AND contains(name_fold, 'src')"),
    "at_root": ("root:", "at_root"),
    "empty": ("empty:", "CASE WHEN is_dir THEN coalesce(k.files + k.dirs, 0) = 0 ELSE clusters = 0 END"),
    "dupe": ("dupe:", "name_fold IN (SELECT name_fold FROM (SELECT name_fold FROM v UNION ALL SELECT '') GROUP BY name_fold HAVING count(*) > 1)"),
    "name_len": ("len:<=6", "length(name) <= 6"),
    "depth_eq": ("parents:3", "depth = 3"),
    "size_cmp": ("size:>1mb", "size_bytes > 1048576"),
    "size_range": ("size:100kb..1mb", "size_bytes BETWEEN 102400 AND 1048576"),
    "size_bucket": ("size:medium", "size_bytes BETWEEN 102400 AND 1048575"),
    "size_beyond": ("size:>17179869184gb | size:<10000000tb !report", "contains(name_fold, 'size:>17179869184gb') OR (size_bytes < 10000000 * 1099511627776::HUGEINT AND NOT contains(name_fold, 'report'))"),
    "child_count": ("childcount:>20", "coalesce(k.files + k.dirs, 0) > 20"),
    "child_file_count": ("childfilecount:5..9", "coalesce(k.files, 0) BETWEEN 5 AND 9"),
    "child_folder_count": ("childfoldercount:2", "coalesce(k.dirs, 0) = 2"),
    "has_child": ("child:readme", "id IN (SELECT parent_id FROM v WHERE contains(name_fold, 'readme'))"),
    "has_child_negated": ("folder: !child:.txt", "is_dir AND id NOT IN (SELECT parent_id FROM v WHERE contains(name_fold, '.txt') AND parent_id IS NOT NULL)"),
    "attrib_reparse": ("attrib:l", "is_reparse"),
    "attrib_directory": ("attrib:d report", "is_dir AND contains(name_fold, 'report')"),
    "bool_or_group": ("report <final | ext:dll> !temp", "contains(name_fold, 'report') AND (contains(name_fold, 'final') OR ext = 'dll') AND NOT contains(name_fold, 'temp')"),
    "negation": ("!file: !attrib:l", "is_dir AND NOT is_reparse"),
    "stray_operators": ("report > final |", "contains(name_fold, 'report') AND contains(name_fold, 'final')"),
    "excludes": (front.compose_excludes("report |", EXCLUDES), f"contains(name_fold, 'report') AND NOT contains(path_fold, 'cache') AND NOT contains(path_fold, {_BS} || 'users' || {_BS})"),
    "seeded_scope": (front.seed_scope("C:\\Users\\", "lib"), f"contains(path_fold, 'c:' || {_BS} || 'users') AND contains(name_fold, 'lib')"),
    "orphans_excluded": ("", "TRUE"),
}


def orphans_included(spark: SparkSession, d: str) -> DataFrame:
    return _find("report", spark, d, include_orphans=True)


def name_case_flag(spark: SparkSession, d: str) -> DataFrame:
    return _find("Report path:USERS", spark, d, case_sensitive=True)


def literal_search(spark: SparkSession, d: str) -> DataFrame:
    return V.search_literal(volume_of(spark, d), "report 1").select("id", "path")


def entries_built(spark: SparkSession, d: str) -> DataFrame:
    return volume_of(spark, d).live.select("id", "frn", "parent_id", "name_fold", "ext", "is_dir", "is_reparse", "is_orphan", "sized", "size_truncated", "clusters", "path")


def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The entries after saving and loading a snapshot."""
    folder = f"{runtime.shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.save(folder, volume_of(spark, d), 1, 2)
    rows = snapshot.load(spark, folder).volume.live
    return rows.select("id", "frn", "parent_id", "name_fold", "ext", "is_dir", "is_reparse", "is_orphan", "sized", "size_truncated", "clusters", "path")


def total_hits(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = V.search(volume_of(spark, d), "report count:5")
    return hits.agg(F.count(F.lit(1)).alias("hits"))


def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.statistics(volume_of(spark, d))


def size_shortfall(spark: SparkSession, d: str) -> DataFrame:
    return V.size_shortfall(V.statistics(volume_of(spark, d)))


def du_root(spark: SparkSession, d: str) -> DataFrame:
    v = volume_of(spark, d)
    return usage.usage_report(v, v.root_id, 1, 20)


def _users(v: V.Volume) -> int:
    row = V.resolve_path(v, "c:/users").first()
    return row["id"] if row else v.root_id


def du_subtree_depth2(spark: SparkSession, d: str) -> DataFrame:
    v = volume_of(spark, d)
    return usage.usage_report(v, _users(v), 2, 50)


def du_total(spark: SparkSession, d: str) -> DataFrame:
    v = volume_of(spark, d)
    return usage.usage_total(v, _users(v))


def du_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Totals of all entries, with their share of the volume in percent and a readable size."""
    v = volume_of(spark, d)
    whole = usage.usage_total(v, v.root_id).first()[0]
    size = F.col("total") * v.cluster_bytes
    return usage.subtree_clusters(v).select("id", "total", "cut", F.round(X.share_percent(F.col("total"), F.lit(whole)), 6).alias("percent"), X.human_size(size).alias("human"))


def path_resolve(spark: SparkSession, d: str) -> DataFrame:
    return V.resolve_path(volume_of(spark, d), "c:/users").select("id", "path")


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return volume_of(spark, d).live.select("id", X.leaf(p).alias("leaf"), X.folder(p).alias("folder"), X.separators(p).alias("seps"), X.path_length(p).alias("path_len"))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return ParquetVolume(spark, d).journal()


def journal_fold(spark: SparkSession, d: str) -> DataFrame:
    return journal.merge_entries(ParquetVolume(spark, d).records(), _feed(spark, d))


def journal_replay_idempotent(spark: SparkSession, d: str) -> DataFrame:
    feed = _feed(spark, d)
    return journal.merge_entries(ParquetVolume(spark, d).records(), feed.unionByName(feed))


def journal_orphans_asof(spark: SparkSession, d: str) -> DataFrame:
    return journal.parents_as_of(ParquetVolume(spark, d).records(), _feed(spark, d)).select("frn", "usn", "parent_frn", "parent_known", "born")


def journal_stream(spark: SparkSession, d: str) -> DataFrame:
    """The state, tombstones included, after the whole feed has gone through a stream."""
    return streaming.stream_state(spark, f"{d}/usn_event.parquet").read()


def size_backlog(spark: SparkSession, d: str) -> DataFrame:
    return journal.size_backlog(_feed(spark, d))


def size_backlog_budget(spark: SparkSession, d: str) -> DataFrame:
    return journal.next_to_measure(journal.size_backlog(_feed(spark, d)))


def sizes_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Sizes after every waiting file was measured at one cluster more than 4294967290 plus its frn's last digit."""
    waiting = journal.size_backlog(_feed(spark, d))
    measured = waiting.select("frn", (F.lit(4294967291) + F.col("frn") % 10).alias("clusters"), F.lit(False).alias("truncated"))
    sizes = ParquetVolume(spark, d).sizes().groupBy("frn").agg(F.max(F.struct("clusters", "truncated")).alias("s")).select("frn", "s.clusters", "s.truncated")
    return journal.record_sizes(sizes, measured)


def size_parts_merged(spark: SparkSession, d: str) -> DataFrame:
    """Entries' clusters summed as parts of base records: rows with an even id are parts of the row before."""
    rows = read_table(spark, d, "entry").where(F.col("id").isNotNull()).select("id", "alloc_clusters").distinct()
    parts = rows.select(F.col("id").alias("frn"), F.when(F.col("id") % 2 == 0, F.col("id") - 1).alias("base_frn"), F.col("alloc_clusters").alias("clusters"), F.lit(False).alias("truncated"))
    return V.merge_size_parts(parts)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read_table(spark, d, "documents").select(F.concat_ws("\\", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name).alias("rel_path"), "text")


def content_grep(spark: SparkSession, d: str) -> DataFrame:
    return content.grep(_texts(spark, d), r"lock\s+file|\bcursor\b")


def content_grep_case(spark: SparkSession, d: str) -> DataFrame:
    return content.grep(_texts(spark, d), "Please note", insensitive=False, root="C:\\docs", scopes=["C:\\docs\\qa_core", "C:\\docs\\qa_code\\en"])


def content_file_counts(spark: SparkSession, d: str) -> DataFrame:
    return content.file_counts(content.grep(_texts(spark, d), "the"))


def content_indexed(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return content.grep_indexed(texts, content.trigram_index(texts), "Lock File")


def view_scope(spark: SparkSession, d: str) -> DataFrame:
    p = F.lower("path")
    return read_table(spark, d, "search_hit").where(view.within_scope(p, "c:\\users") & view.without_excludes(p, ["cache", "temp"])).select("hit_id", "path").distinct()


def view_rules_longest(spark: SparkSession, d: str) -> DataFrame:
    verdict = view.rule_verdict(F.lower("path"), RULES)
    return volume_of(spark, d).live.select("id", verdict.alias("include"))


def view_per_name_cap(spark: SparkSession, d: str) -> DataFrame:
    return view.cap_per_name(volume_of(spark, d).live.withColumn("rank_pos", F.col("id")), front.PER_NAME).select("id", "path")


def _page(spark: SparkSession, d: str) -> DataFrame:
    """All hits of a query with the time their record was last seen as mtime; rank_pos orders them as a rank would, without a
    count through all of them."""
    v = volume_of(spark, d)
    hits, query = V.search(v, "re")
    ranked = hits.withColumn("rank_pos", F.struct(V.rank_class(query, False).alias("class"), X.path_length(F.col("path")).alias("path_len"), F.col("id")))
    seen = read_table(spark, d, "raw_record").groupBy(F.col("ord").alias("id")).agg(F.max("seen_at").alias("mtime"))
    return ranked.join(seen, "id", "left")


def view_near_first(spark: SparkSession, d: str) -> DataFrame:
    return view.near_first(_page(spark, d), 500).select("id", "path")


def view_folders_newest(spark: SparkSession, d: str) -> DataFrame:
    page = _page(spark, d).orderBy("rank_pos").limit(front.rows_to_show("re"))
    return view.numbered(page, view.folders_then_newest(page)).select(F.col("row_no").cast("long").alias("row_no"), "id")


def view_page(spark: SparkSession, d: str) -> DataFrame:
    """Rows 11 to 40 of the finished page."""
    rows = _page(spark, d)
    return view.fetch_rows(view.page_of(rows, rows.count(), "re", "c:\\lab", ["temp"], RULES), 11, 30).select(F.col("row_no").cast("long").alias("row_no"), "id")


def view_properties(spark: SparkSession, d: str) -> DataFrame:
    page = _page(spark, d).orderBy("rank_pos").limit(200).withColumn("attributes", F.lit(None).cast("int"))
    return view.row_properties(view.numbered(page, view.folders_then_newest(page))).select("parsing_path", "item_name", "folder_display", F.col("rank").cast("long").alias("rank"), F.col("attributes").cast("int").alias("attributes"), "item_type", "size")


def percent_decode(spark: SparkSession, d: str) -> DataFrame:
    """Paths of hits, percent-encoded and decoded again."""
    coded = F.replace(F.replace(F.replace("path", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit("é"), F.lit("%C3%a9"))
    return read_table(spark, d, "search_hit").select("hit_id", X.percent_decode_column(coded).alias("path")).distinct()


def highlight_spans(spark: SparkSession, d: str) -> DataFrame:
    query = "re final"
    spans = highlight.spans_column(F.col("path"), query)
    return V.search(volume_of(spark, d), query)[0].select("id", spans.alias("spans")).select("id", F.size("spans").alias("n"), F.col("spans")[0]["start"].alias("first_start"), F.col("spans")[0]["end"].alias("first_end"))


QUERIES = {name: partial(_find, text) for name, (text, _) in _SEARCHES.items()}
QUERIES |= {
    "rank_topk": partial(_rank, "report", 100, 0), "rank_operator_only": partial(_rank, "ext:dll", 50, 0), "rank_reserve": partial(_rank, "final", 60, 20), "count_cap": partial(_rank, "report count:7", 100, 0),
}
QUERIES |= {
    f.__name__: f
    for f in (
        orphans_included, name_case_flag, literal_search, entries_built, snapshot_roundtrip, total_hits, stats_counts, size_shortfall, du_root, du_subtree_depth2, du_total, du_subtrees, path_resolve, path_parts, journal_fold,
        journal_replay_idempotent, journal_orphans_asof, journal_stream, size_backlog, size_backlog_budget, sizes_recorded, size_parts_merged, content_grep, content_grep_case, content_file_counts, content_indexed, view_scope,
        view_rules_longest, view_per_name_cap, view_near_first, view_folders_newest, view_page, view_properties, percent_decode, highlight_spans,
    )
}


def _ranked(cond: str, needle: str | None, limit: int) -> str:
    cls = f"CASE WHEN name_fold = '{needle}' THEN 0 WHEN starts_with(name_fold, '{needle}') THEN 1 ELSE 2 END" if needle else "2"
    return f"{_VOL}, h AS (SELECT v.id, v.path, {cls} AS class, strlen(path) + 1 AS path_len {_FROM} WHERE NOT is_orphan AND ({cond})) SELECT row_number() OVER (ORDER BY class, path_len, id) AS rank_pos, id, path FROM h QUALIFY rank_pos <= {limit}"


_ENTRIES_SQL = _VOL + "SELECT id, frn, parent_id, name_fold, ext, is_dir, is_reparse, is_orphan, sized, size_truncated, clusters, path FROM v JOIN ex USING (id)"
_STATS = _VOL + """, l AS (SELECT is_dir, is_orphan, sized, size_truncated, clusters FROM v UNION ALL SELECT TRUE, FALSE, FALSE, FALSE, 0),
s AS (SELECT count(*) AS entries, count(*) FILTER (is_dir) AS folders, count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_orphan) AS orphans, count(*) FILTER (NOT is_dir AND NOT sized) AS unsized_files,
  count(*) FILTER (is_dir OR sized) AS sizes_resolved, count(*) FILTER (size_truncated) AS truncated, CAST(sum(clusters) AS BIGINT) AS clusters FROM l) """
_UP = _VOL + """, up AS (SELECT id AS leaf, id AS at_id, 0 AS dist FROM v WHERE NOT is_orphan UNION ALL SELECT up.leaf, v.parent_id, up.dist + 1 FROM up JOIN v ON v.id = up.at_id),
tot AS (SELECT at_id AS id, CAST(sum(v.clusters) AS BIGINT) AS total, bool_or(v.size_truncated) AS cut FROM up JOIN v ON v.id = up.leaf GROUP BY at_id),
users AS (SELECT min(id) AS uid FROM v WHERE NOT is_orphan AND path_fold = 'c:' || chr(92) || 'users') """
_EV = """ev AS (SELECT usn, frn, min(struct_pack(p := parent_frn, r := reason, n := name, a := attributes)) AS e FROM usn_event WHERE usn IS NOT NULL AND frn IS NOT NULL GROUP BY usn, frn),
st AS (SELECT usn, frn, e.p AS parent_frn, e.n AS name, (e.r & 512) <> 0 AS del FROM ev WHERE (e.r & 512) <> 0 OR ((e.r & 8448) <> 0 AND NOT ((e.r & 4096) <> 0 AND (e.r & 8192) = 0)))"""
_MERGED = f"""WITH {_EV}, b AS (SELECT DISTINCT frn, ord - 4611686018427387904 AS usn, parent_frn, name_utf16 AS name FROM raw_record WHERE frn IS NOT NULL AND ord IS NOT NULL),
a AS (SELECT frn, usn, parent_frn, name, FALSE AS del FROM b UNION ALL SELECT frn, usn, parent_frn, name, del FROM st)
SELECT frn, parent_frn, name, del AS is_dead, usn >= 0 AS from_feed FROM a QUALIFY row_number() OVER (PARTITION BY frn ORDER BY usn DESC) = 1"""
_BACKLOG = f"""WITH {_EV} SELECT frn, min(usn) AS first_usn FROM ev WHERE (e.r & 263) <> 0 AND (e.r & 512) = 0 AND (coalesce(e.a, 0) & 16) = 0 GROUP BY frn"""
_LINES = r"""WITH t AS (SELECT concat_ws(chr(92), coalesce(source, 'none'), coalesce(lang, 'none'), 'doc_' || doc_id || '.txt') AS rel_path, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT rel_path, CAST(i AS INTEGER) AS line_number, regexp_replace(l[i], '\r+\z', '') AS text FROM (SELECT rel_path, l, unnest(range(1, len(l) + 1)) AS i FROM t)) """
_RULE_SQL = r"""CASE WHEN regexp_matches(h, '^c:\\users\\import[^\\]*\\') THEN TRUE WHEN regexp_matches(h, '^c:\\users\\') THEN FALSE WHEN regexp_matches(h, '^[^\\]*\\lab\\') THEN FALSE WHEN regexp_matches(h, '^c:\\[^\\]*\\') THEN TRUE END"""
_PAGE = _VOL + """, seen AS (SELECT ord AS id, max(seen_at) AS mtime FROM raw_record GROUP BY ord),
h AS (SELECT v.id, path, is_dir, size_bytes, CASE WHEN name_fold = 're' THEN 0 WHEN starts_with(name_fold, 're') THEN 1 ELSE 2 END AS class, strlen(path) + 1 AS path_len FROM v WHERE NOT is_orphan AND contains(name_fold, 're')),
pg AS (SELECT h.*, mtime, row_number() OVER (ORDER BY class, path_len, h.id) AS rank_pos FROM h LEFT JOIN seen USING (id) QUALIFY rank_pos <= 30000) """

ORACLE = {name: _where(cond) for name, (_, cond) in _SEARCHES.items()}
ORACLE |= {
    "orphans_included": _where("contains(name_fold, 'report')", "TRUE"),
    "name_case_flag": _where("contains(name, 'Report') AND contains(path_fold, 'users')"),
    "literal_search": _where("contains(name_fold, 'report 1')"),
    "entries_built": _ENTRIES_SQL,
    "snapshot_roundtrip": _ENTRIES_SQL,
    "total_hits": f"{_VOL} SELECT count(*) AS hits FROM v WHERE NOT is_orphan AND contains(name_fold, 'report')",
    "stats_counts": _STATS + "SELECT * FROM s",
    "size_shortfall": _STATS + "SELECT entries, sizes_resolved, entries - sizes_resolved AS missing, sizes_resolved * 10 < entries * 9 AS warn FROM s",
    "rank_topk": _ranked("contains(name_fold, 'report')", "report", 100),
    "rank_operator_only": _ranked("ext = 'dll'", None, 50),
    "count_cap": _ranked("contains(name_fold, 'report')", "report", 7),
    "rank_reserve": f"""{_VOL}, h AS (SELECT id, path, CASE WHEN name_fold = 'final' THEN 0 WHEN starts_with(name_fold, 'final') THEN 1 ELSE 2 END AS class, strlen(path) + 1 AS path_len FROM v WHERE NOT is_orphan AND contains(name_fold, 'final')),
r AS (SELECT *, row_number() OVER (ORDER BY class, path_len, id) AS r, row_number() OVER (PARTITION BY class = 2 ORDER BY class, path_len, id) AS c2 FROM h),
k AS (SELECT count(*) FILTER (class = 2 AND r <= 60) AS have, least(20, count(*) FILTER (class = 2)) AS want FROM r),
kept AS (SELECT r.* FROM r, k WHERE CASE WHEN class = 2 THEN c2 <= have + greatest(0, want - have) ELSE r <= 60 AND c2 <= 60 - have - greatest(0, want - have) END)
SELECT row_number() OVER (ORDER BY class, path_len, id) AS rank_pos, id, path FROM kept""",
    "du_root": _UP + "SELECT id, name, 1 AS depth, total AS clusters, total * cluster_bytes AS size_bytes, cut AS truncated FROM v JOIN tot USING (id) WHERE at_root AND NOT is_orphan ORDER BY total DESC, name, id LIMIT 20",
    "du_subtree_depth2": _UP + """, d AS (SELECT up.leaf AS id, dist AS depth FROM up, users WHERE at_id = uid AND dist BETWEEN 1 AND 2)
SELECT id, name, d.depth AS depth, total AS clusters, total * cluster_bytes AS size_bytes, cut AS truncated FROM v JOIN tot USING (id) JOIN d USING (id) ORDER BY total DESC, name, id LIMIT 50""",
    "du_total": _UP + "SELECT total AS clusters, cut AS truncated FROM tot, users WHERE id = uid",
    "du_subtrees": _UP + """, w AS (SELECT sum(clusters) AS whole FROM v WHERE NOT is_orphan), x AS (SELECT id, total, cut, total * cluster_bytes AS b FROM tot JOIN v USING (id))
SELECT id, total, cut, round(CASE WHEN whole > 0 THEN 100.0 * total / whole ELSE 0 END, 6) AS percent, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0)
  WHEN b < 1099511627776 THEN printf('%.1f GiB', b / 1073741824.0) ELSE printf('%.1f TiB', b / 1099511627776.0) END AS human FROM x, w""",
    "path_resolve": _VOL + "SELECT id, path FROM v WHERE NOT is_orphan AND path_fold = 'c:' || chr(92) || 'users' ORDER BY id LIMIT 1",
    "path_parts": _VOL + r"""SELECT id, regexp_extract(path, '(?s)([^\\/]*)\z', 1) AS leaf, regexp_extract(path, '(?s)^(.*)[\\/][^\\/]*\z', 1) AS folder, CAST(length(path) - length(translate(path, chr(92) || '/', '')) AS INTEGER) AS seps, CAST(strlen(path) + 1 AS INTEGER) AS path_len FROM v""",
    "journal_fold": _MERGED,
    "journal_replay_idempotent": _MERGED,
    "journal_orphans_asof": f"""WITH {_EV}, l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY frn ORDER BY usn DESC) = 1), rec AS (SELECT DISTINCT frn FROM raw_record WHERE frn IS NOT NULL),
p AS (SELECT l.frn, l.usn, l.parent_frn, arg_max(s.del, s.usn) AS pdel FROM l LEFT JOIN st s ON s.frn = l.parent_frn AND s.usn < l.usn WHERE NOT l.del GROUP BY ALL),
dd AS (SELECT frn, max(usn) AS d FROM st WHERE del GROUP BY frn),
b AS (SELECT s.frn, min(s.usn) AS u FROM st s LEFT JOIN dd USING (frn) WHERE NOT s.del AND s.usn > coalesce(dd.d, -1) GROUP BY s.frn)
SELECT p.frn, p.usn, p.parent_frn, coalesce(CASE WHEN p.parent_frn = 5 THEN TRUE WHEN pdel IS NOT NULL THEN NOT pdel ELSE r.frn IS NOT NULL END, FALSE) AS parent_known,
  CASE WHEN dd.d IS NULL AND o.frn IS NOT NULL THEN -4611686018427387904 ELSE b.u END AS born
FROM p LEFT JOIN rec r ON r.frn = p.parent_frn LEFT JOIN dd ON dd.frn = p.frn LEFT JOIN rec o ON o.frn = p.frn LEFT JOIN b ON b.frn = p.frn""",
    "journal_stream": f"WITH {_EV} SELECT frn, usn, del AS deleted, parent_frn FROM st QUALIFY row_number() OVER (PARTITION BY frn ORDER BY usn DESC) = 1",
    "size_backlog": _BACKLOG,
    "size_backlog_budget": _BACKLOG + " ORDER BY first_usn, frn LIMIT 4096",
    "sizes_recorded": f"""WITH w AS ({_BACKLOG}), s AS (SELECT frn, max(struct_pack(c := clusters, t := truncated)) AS s FROM size_row GROUP BY frn)
SELECT coalesce(w.frn, s.frn) AS frn, CASE WHEN w.frn IS NOT NULL THEN least(4294967291 + w.frn % 10, 4294967295) ELSE s.s.c END AS clusters, CASE WHEN w.frn IS NOT NULL THEN 4294967291 + w.frn % 10 > 4294967295 ELSE s.s.t END AS truncated FROM w FULL JOIN s USING (frn)""",
    "size_parts_merged": """WITH r AS (SELECT DISTINCT id, coalesce(alloc_clusters, 0) AS n FROM entry WHERE id IS NOT NULL), g AS (SELECT CASE WHEN id % 2 = 0 THEN id - 1 ELSE id END AS frn, sum(n) AS n, bool_or(id % 2 <> 0) AS based FROM r GROUP BY 1)
SELECT frn, CAST(least(n, 4294967295) AS BIGINT) AS clusters, n > 4294967295 AS truncated FROM g WHERE based""",
    "content_grep": _LINES + r"SELECT * FROM x WHERE regexp_matches(text, '(?i)lock\s+file|\bcursor\b')",
    "content_grep_case": _LINES + "SELECT * FROM x WHERE contains(text, 'Please note') AND (starts_with(rel_path, 'qa_core' || chr(92)) OR starts_with(rel_path, concat_ws(chr(92), 'qa_code', 'en', '')))",
    "content_file_counts": _LINES + "SELECT rel_path, count(*) AS lines FROM x WHERE regexp_matches(text, '(?i)the') GROUP BY rel_path",
    "content_indexed": _LINES + "SELECT * FROM x WHERE contains(lower(text), 'lock file')",
    "view_scope": "SELECT DISTINCT hit_id, path FROM search_hit WHERE (lower(path) = 'c:' || chr(92) || 'users' OR starts_with(lower(path), concat_ws(chr(92), 'c:', 'users', ''))) AND NOT contains(lower(path), 'cache') AND NOT contains(lower(path), 'temp')",
    "view_rules_longest": f"{_VOL}, x AS (SELECT id, CASE WHEN suffix(path, chr(92)) THEN lower(path) ELSE lower(path) || chr(92) END AS h FROM v) SELECT id, {_RULE_SQL} AS include FROM x",
    "view_per_name_cap": _VOL + r"SELECT id, path FROM v QUALIFY row_number() OVER (PARTITION BY regexp_extract(lower(path), '(?s)([^\\/]*)\z', 1) ORDER BY id) <= 3",
    "view_near_first": _PAGE + "SELECT id, path FROM pg ORDER BY length(path) - length(translate(path, chr(92) || '/', '')), rank_pos LIMIT 500",
    "view_folders_newest": _PAGE + "SELECT row_number() OVER (ORDER BY is_dir DESC, mtime DESC NULLS LAST, rank_pos) AS row_no, id FROM pg WHERE rank_pos <= 1000",
    "view_page": _PAGE + f""", f AS (SELECT *, lower(path) || chr(92) AS h FROM pg), g AS (SELECT * FROM f WHERE starts_with(h, concat_ws(chr(92), 'c:', 'lab', '')) AND NOT contains(lower(path), 'temp') AND coalesce({_RULE_SQL}, TRUE)
  ORDER BY length(path) - length(translate(path, chr(92) || '/', '')), rank_pos LIMIT 1000), n AS (SELECT row_number() OVER (ORDER BY is_dir DESC, mtime DESC NULLS LAST, rank_pos) AS row_no, id FROM g) SELECT * FROM n WHERE row_no BETWEEN 11 AND 40""",
    "view_properties": _PAGE + r""", n AS (SELECT *, row_number() OVER (ORDER BY is_dir DESC, mtime DESC NULLS LAST, rank_pos) AS row_no, regexp_extract(path, '(?s)([^\\/]*)\z', 1) AS leaf FROM pg WHERE rank_pos <= 200)
SELECT path AS parsing_path, leaf AS item_name, regexp_extract(path, '(?s)^(.*)[\\/][^\\/]*\z', 1) AS folder_display, 1000000 - row_no AS rank, CASE WHEN is_dir THEN 16 ELSE 128 END AS attributes,
  CASE WHEN is_dir THEN 'Directory' ELSE regexp_extract(leaf, '(?s)(\.[^.]*)\z', 1) END AS item_type, CASE WHEN NOT is_dir THEN size_bytes END AS size FROM n""",
    "percent_decode": "SELECT DISTINCT hit_id, path FROM search_hit",
    "highlight_spans": _VOL + r""", x AS (SELECT id, path, regexp_extract(path, '(?s)([^\\/]*)\z', 1) AS leaf FROM v WHERE NOT is_orphan AND contains(name_fold, 're') AND contains(name_fold, 'final')),
y AS (SELECT id, CAST(len(regexp_extract_all(lower(leaf), '(?:re|final)+')) AS INTEGER) AS n, CAST(length(path) - length(leaf) + length(regexp_extract(lower(leaf), '(?s)^(.*?)(?:re|final)', 1)) AS INTEGER) AS first_start, length(regexp_extract(lower(leaf), '(?:re|final)+')) AS l FROM x)
SELECT id, n, first_start, CAST(first_start + l AS INTEGER) AS first_end FROM y""",
}
