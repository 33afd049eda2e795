"""Registered queries of sources, sinks, request handling, views and the followed volume, with the SQL of the same rows.

What works on one request or one value is shown on lists of them; everything else runs over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_engine as Q
from . import runtime
from .functions import text as X
from .operators import content, journal, live, view
from .operators import volume as V
from .plans import front
from .plans.syntax import GROUPS, MAX_NESTING
from .queries_engine import volume_of
from .runtime import read_table
from .service import RecentAnswers, Service
from .sources import sinks, snapshot
from .sources.volumes import MemoryVolume, ParquetVolume
from .streaming.journal import Watched

EXCLUDES_FILE = "\ufeff# folders of no interest\r\n  cache \r\n\r\n\\users\\\n"
LEAVES = [("System.Generic.String", "re*"), ("System.ItemFolderPathDisplay", "file:C:/lab")]
URL = "search-ms:displayname=found&crumb=System.Generic.String%3A(st)&crumb=location:C%3A%5Clab"
RULE_URLS = [("file:///C:\\[0a1b]\\", True), ("file:///C:\\[0a1b]\\Users\\", False), ("mapi://x", True)]


def _find(text: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: V.search(volume_of(spark, d), text, **options)[0].select("id", "path")


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def cluster_runs(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of three runs made up for every entry, one of them a hole."""
    rows = read_table(spark, d, "entry").where(F.col("id").isNotNull()).select("id", "alloc_clusters").distinct()
    run = lambda n, sparse: F.struct(n.cast("long").alias("length"), F.lit(sparse).alias("sparse"))
    runs = F.array(run(F.coalesce("alloc_clusters", F.lit(0)), False), run(F.col("id") % 7, True), run(F.col("id") % 5, False))
    return rows.select("id", "alloc_clusters", V.run_clusters(runs).alias("clusters"))


def empty_volume(spark: SparkSession, d: str) -> DataFrame:
    return V.empty_volume(spark, "D").entries.select("id", "path", "is_dir", "clusters")


def memory_volume(spark: SparkSession, d: str) -> DataFrame:
    m = MemoryVolume(spark, [(0, 5, 5, "", 16), (1, 10, 5, "a", 16), (2, 11, 10, "b.txt", 0), (3, 12, 99, "lost", 0)], [(11, 3, False)], [])
    return V.build_entries(m.records(), m.sizes(), m.drive, m.cluster_bytes, m.root_frn).live.select("id", "path", "is_orphan", "size_bytes")


def paths_sink(spark: SparkSession, d: str) -> DataFrame:
    """Paths of hits, written as text and read again."""
    folder = f"{runtime.shared_folder(spark)}/paths-{uuid.uuid4().hex}"
    sinks.write_paths(V.search(volume_of(spark, d), "ext:dll")[0], folder)
    return spark.read.text(folder, lineSep="\n").select(F.col("value").alias("path"))


def listing_sink(spark: SparkSession, d: str) -> DataFrame:
    """The listing of a page of five."""
    hits, query = V.search(volume_of(spark, d), "report")
    return _values(spark, [(sinks.listing(V.top_ranked(hits, query, 5), hits.count(), query.words),)], "listing string")


def excludes_file(spark: SparkSession, d: str) -> DataFrame:
    return _find(front.compose_excludes("file: re |", front.parse_excludes(EXCLUDES_FILE)))(spark, d)


def crawl_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [r for url, include in RULE_URLS if (r := view.rule_from_url(url, include))]
    return volume_of(spark, d).live.select("id", view.rule_verdict(F.lower("path"), rules).alias("include"))


def shell_condition(spark: SparkSession, d: str) -> DataFrame:
    term, scope = front.shell_query(LEAVES)
    return V.search(volume_of(spark, d), term)[0].where(view.within_scope(F.lower("path"), scope.lower())).select("id", "path")


def search_url(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = V.search(volume_of(spark, d), front.term_from_url(URL))
    return hits.where(view.within_scope(F.lower("path"), front.scope_from_url(URL).lower())).select("id", "path")


def join_arguments(spark: SparkSession, d: str) -> DataFrame:
    return _find(front.join_arguments(["file:", "re"]))(spark, d)


def servable_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = ["C:\\a", "c:/a", "D:\\a", "\\a", "a", ""]
    return _values(spark, [(p, front.servable(p, ParquetVolume(spark, d).drive)) for p in paths], "path string, ok boolean")


def request_caps(spark: SparkSession, d: str) -> DataFrame:
    asked = [(0, 0), (50, 60), (10**7, 10**7), (-1, 5)]
    got = [(n, r, c.limit, c.reserve) for n, r in asked if (c := front.SearchRequest("x", n, reserve=r).clamped())]
    return _values(spark, got, "asked long, wanted long, top long, reserve long")


def usage_caps(spark: SparkSession, d: str) -> DataFrame:
    asked = [(0, 0), (3, 20), (1000, 10**6)]
    return _values(spark, [(n, r, c.depth, c.rows) for n, r in asked if (c := front.UsageRequest("x", n, r).clamped())], "depth long, asked long, levels long, shown long")


def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, [(t, front.rows_to_show(t), front.rows_to_fetch(t)) for t in ("", "r", "re", "rep", "report")], "term string, shown long, fetched long")


def path_of_frn(spark: SparkSession, d: str) -> DataFrame:
    """The path of the frn of the greatest id."""
    v = volume_of(spark, d)
    row = v.live.orderBy(F.col("id").desc()).select("frn").first()
    return V.path_of_frn(v, row["frn"] if row else -1)


def clusters_with_commas(spark: SparkSession, d: str) -> DataFrame:
    return volume_of(spark, d).live.select("id", X.with_commas(F.col("size_bytes")).alias("shown"))


def seconds_shown(spark: SparkSession, d: str) -> DataFrame:
    runtime.ship_package(spark)
    shown = F.pandas_udf(lambda s: s.map(X.human_seconds), "string")
    return spark.range(100_000).select(F.col("id").alias("seconds"), shown("id").alias("shown"))


def paths_elided(spark: SparkSession, d: str) -> DataFrame:
    cases = [("C:\\users\\import\\report.txt", w) for w in (80, 26, 25, 20, 12, 5)] + [("name", 2), ("C:\\目録\\表.txt", 12), ("C:\\e\u0301t\\x", 5)]
    return _values(spark, [(p, w, X.elide_from(p, w)) for p, w in cases], "path string, width long, start long")


def absolute_paths(spark: SparkSession, d: str) -> DataFrame:
    """Names of hits as arguments given in a folder."""
    runtime.ship_package(spark)
    put = F.pandas_udf(lambda s: s.map(lambda p: X.absolute_argument(p, "C:\\lab"), na_action="ignore").astype(object), "string")
    name = X.leaf(F.col("path"))
    return read_table(spark, d, "search_hit").select("hit_id", put(name).alias("path")).distinct()


def nearest_ranks(spark: SparkSession, d: str) -> DataFrame:
    values = list(range(10, 130, 10))
    return _values(spark, [(s, X.nearest_rank(values, s)) for s in (0.0, 0.5, 0.9, 0.99, 1.0)] + [(0.25, X.nearest_rank([], 0.25))], "share double, value long")


def status_report(spark: SparkSession, d: str) -> DataFrame:
    source = ParquetVolume(spark, d)
    return V.status(volume_of(spark, d), 100, source.next_usn()).select("phase", "drive", "lag", "entries", "files", "orphans")


def building_phase(spark: SparkSession, d: str) -> DataFrame:
    return Service(spark).status().select("phase", "entries", "lag")


def recent_answers(spark: SparkSession, d: str) -> DataFrame:
    """Which of some requests are answered anew: two are kept, each for 15 seconds."""
    now, made, out = [0.0], [], []
    kept = RecentAnswers(most=2, seconds=15, clock=lambda: now[0])
    for i, (at, key) in enumerate([(0, "a"), (1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "a"), (6, "b"), (30, "b")]):
        now[0], before = float(at), len(made)
        kept.get((key, ""), lambda k=key: made.append(k) or k)
        out.append((i, key, len(made) > before))
    return _values(spark, out, "n long, term string, anew boolean")


def discontinuities(spark: SparkSession, d: str) -> DataFrame:
    cases = [(5, 1, 1, 0), (5, 1, 1, 5), (5, 1, 1, 6), (5, 1, 2, 0)]
    return _values(spark, [(*c, journal.discontinuity(*c)) for c in cases], "place long, known long, now long, first long, why string")


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows 11 to 40 of a page without a scope, and the same read backwards from row 40."""
    rows = Q._page(spark, d)
    page = runtime.materialise(view.page_of(rows, rows.count(), "re"))
    one = lambda start, n, way: view.fetch_rows(page, start, n).select(F.lit(way).alias("way"), F.col("row_no").cast("long").alias("row_no"), "id")
    return one(11, 30, "on").unionByName(one(40, -30, "back"))


def _followed(spark: SparkSession, d: str) -> V.Volume:
    return live.apply_events(volume_of(spark, d), ParquetVolume(spark, d).journal(), ParquetVolume(spark, d).root_frn)


def _live_rows(volume: V.Volume) -> DataFrame:
    return volume.entries.where(F.col("id") != volume.root_id).select("id", "frn", "parent_id", "name_fold", "is_dir", "is_dead", "is_orphan", "sized", "clusters", "path")


def live_applied(spark: SparkSession, d: str) -> DataFrame:
    """All slots, dead ones included, after the whole feed is applied to the enumerated volume."""
    return _live_rows(_followed(spark, d))


def live_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The same from a snapshot that was saved before the feed and resumed."""
    folder, source = f"{runtime.shared_folder(spark)}/snapshot-{uuid.uuid4().hex}", ParquetVolume(spark, d)
    snapshot.save(folder, volume_of(spark, d), source.journal_id, source.first_usn())
    w = Watched.resume(source, folder)
    w.volume = live.apply_events(w.volume, source.journal(w.cursor), source.root_frn)
    return _live_rows(w.volume)


def live_garbage(spark: SparkSession, d: str) -> DataFrame:
    return V.tombstone_ratio(_followed(spark, d)).select(F.round("ratio", 9).alias("ratio"))


def live_measured(spark: SparkSession, d: str) -> DataFrame:
    """Sizes after one poll measured the files that had waited longest at one cluster more than their frn's last three digits."""
    turn = journal.next_to_measure(journal.size_backlog(ParquetVolume(spark, d).journal()))
    measured = turn.select("frn", (F.col("frn") % 1000 + 1).alias("clusters"), F.lit(False).alias("truncated"))
    return live.record_measured(volume_of(spark, d), measured, ParquetVolume(spark, d).root_frn).live.select("id", "sized", "clusters")


def watch_recovers(spark: SparkSession, d: str) -> DataFrame:
    """The entries once a followed volume met another journal and was built anew."""
    source = ParquetVolume(spark, d)
    w = Watched(source, V.empty_volume(spark, source.drive), 0, source.journal_id - 1)
    w.run(1, seconds=0)
    return w.volume.live.select("id", "frn", "parent_id", "name_fold", "ext", "is_dir", "is_reparse", "is_orphan", "sized", "size_truncated", "clusters", "path")


def content_grouped(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"lock\s+file|\bcursor\b"
    return sinks.grouped_lines(content.grep(Q._texts(spark, d), pattern), pattern).select("rel_path", F.concat_ws("\n", "lines").alias("shown"))


def content_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """A search through an index that was made of older texts and brought up to date."""
    texts = Q._texts(spark, d)
    older = texts.select("rel_path", F.when(F.xxhash64("rel_path") % 2 == 0, F.concat("text", F.lit(" lock"))).otherwise(F.col("text")).alias("text"))
    index = content.refresh_index(runtime.materialise(content.sealed_index(older)), texts)
    return content.grep_indexed(texts, index, "Lock File")


QUERIES = {
    "name_and_two": _find("re st"), "stray_ends": _find("re > st |"), "seeded_lab": _find(front.seed_scope("C:\\Lab\\", "re")), "literal_case": lambda spark, d: V.search_literal(volume_of(spark, d), "Re", insensitive=False).select("id", "path"),
    "case_flag_two": _find("Re path:LAB", case_sensitive=True), "nested_groups": _find("<" * (MAX_NESTING - 1) + "report" + ">" * (MAX_NESTING - 1)), "simplified_all": _find("report | <>"), "simplified_one": _find("<> re <>"),
    "type_audio": _find("audio:"), "type_archive": _find("zip:"), "type_document": _find("doc:"), "type_code": _find("code:"),
}
QUERIES |= {
    f.__name__: f
    for f in (
        cluster_runs, empty_volume, memory_volume, paths_sink, listing_sink, excludes_file, crawl_rules, shell_condition, search_url, join_arguments, servable_paths, request_caps, usage_caps, page_sizes, path_of_frn, clusters_with_commas,
        seconds_shown, paths_elided, absolute_paths, nearest_ranks, status_report, building_phase, recent_answers, discontinuities, page_rows, live_applied, live_replayed, live_garbage, live_measured, watch_recovers, content_grouped, content_refreshed,
    )
}

_BS = "chr(92)"
_LAB = f"(lower(path) = concat('c:', {_BS}, 'lab') OR starts_with(lower(path), concat('c:', {_BS}, 'lab', {_BS})))"
_LIVE = Q._VOL + f""", {Q._EV},
atr AS (SELECT usn, frn, e.a AS attributes FROM ev),
base AS (SELECT frn, max(id) AS id FROM lk GROUP BY frn),
steps AS (SELECT frn, -1 AS usn, FALSE AS del FROM base UNION ALL SELECT frn, usn, del FROM st),
turns AS (SELECT *, lead(usn) OVER (PARTITION BY frn ORDER BY usn) AS died FROM (SELECT *, lag(del) OVER (PARTITION BY frn ORDER BY usn) AS before FROM steps) WHERE before IS NULL OR before <> del),
lives AS (SELECT frn, usn AS born, died FROM turns WHERE NOT del),
ids AS (SELECT l.frn, l.born, l.died, CASE WHEN l.born = -1 THEN b.id ELSE (SELECT root_id FROM one) + row_number() OVER (PARTITION BY l.born = -1 ORDER BY l.died IS NOT NULL, l.born, l.frn) END AS id FROM lives l LEFT JOIN base b ON b.frn = l.frn AND l.born = -1),
lst AS (SELECT i.id, i.frn, arg_max(struct_pack(u := s.usn, p := s.parent_frn, n := s.name, a := atr.attributes), s.usn) AS e FROM st s JOIN atr USING (usn, frn) JOIN ids i ON i.frn = s.frn AND s.usn >= i.born AND (i.died IS NULL OR s.usn < i.died) WHERE NOT s.del GROUP BY i.id, i.frn),
mv AS (SELECT l.id, l.frn, coalesce(l.e.n, '') AS name, coalesce(l.e.a, 0) AS attributes, CASE WHEN l.e.p = one.root_frn THEN one.root_id WHEN p.id <> l.id THEN p.id END AS parent_id
  FROM lst l CROSS JOIN one LEFT JOIN ids p ON p.frn = l.e.p AND l.e.u > p.born AND (p.died IS NULL OR l.e.u < p.died)),
nx AS MATERIALIZED (SELECT coalesce(lk.id, mv.id) AS id, coalesce(lk.frn, mv.frn) AS frn, CASE WHEN mv.id IS NULL THEN lk.parent_id ELSE mv.parent_id END AS parent_id, coalesce(mv.name, lk.name) AS name, coalesce(mv.attributes, lk.attributes) AS attributes,
    coalesce(i.died IS NOT NULL, FALSE) AS is_dead, coalesce(lk.sized, FALSE) AS sized, coalesce(lk.clusters, 0) AS clusters FROM lk FULL JOIN mv ON mv.id = lk.id LEFT JOIN ids i ON i.id = coalesce(lk.id, mv.id)),
t2 AS (SELECT id, CASE WHEN parent_id IS NULL THEN '<orphan>' ELSE 'C:' END || {_BS} || name AS path, parent_id IS NULL AS is_orphan FROM nx, one WHERE parent_id IS NULL OR parent_id = root_id
  UNION ALL SELECT nx.id, t2.path || {_BS} || nx.name, t2.is_orphan FROM nx JOIN t2 ON nx.parent_id = t2.id)
"""
_LIVE_ROWS = _LIVE + f"""SELECT nx.id, frn, parent_id, lower(translate(name, 'Σ', 'σ')) AS name_fold, (attributes & 16) <> 0 AS is_dir, is_dead, coalesce(t2.is_orphan, TRUE) AS is_orphan, sized, clusters,
  coalesce(t2.path, '<orphan>' || {_BS} || name) AS path FROM nx LEFT JOIN t2 USING (id)"""


def _list(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


ORACLE = {
    "name_and_two": Q._where("contains(name_fold, 're') AND contains(name_fold, 'st')"),
    "stray_ends": Q._where("contains(name_fold, 're') AND contains(name_fold, 'st')"),
    "seeded_lab": Q._where(f"contains(path_fold, 'c:' || {_BS} || 'lab') AND contains(name_fold, 're')"),
    "literal_case": Q._where("contains(name, 'Re')"),
    "case_flag_two": Q._where("contains(name, 'Re') AND contains(path_fold, 'lab')"),
    "nested_groups": Q._where("contains(name_fold, 'report')"),
    "simplified_all": Q._where("TRUE"),
    "simplified_one": Q._where("contains(name_fold, 're')"),
    "cluster_runs": "SELECT DISTINCT id, alloc_clusters, CAST(coalesce(alloc_clusters, 0) + id % 5 AS BIGINT) AS clusters FROM entry WHERE id IS NOT NULL",
    "empty_volume": f"SELECT CAST(0 AS BIGINT) AS id, concat('D:', {_BS}) AS path, TRUE AS is_dir, CAST(0 AS BIGINT) AS clusters",
    "memory_volume": _list("id, path, is_orphan, size_bytes", f"1, concat('C:', {_BS}, 'a'), FALSE, 0", f"2, concat('C:', {_BS}, 'a', {_BS}, 'b.txt'), FALSE, 12288", f"3, concat('<orphan>', {_BS}, 'lost'), TRUE, 0"),
    "paths_sink": f"{Q._VOL} SELECT path {Q._FROM} WHERE NOT is_orphan AND ext = 'dll'",
    "listing_sink": f"""{Q._VOL}, h AS (SELECT v.id, path, is_dir, CASE WHEN name_fold = 'report' THEN 0 WHEN starts_with(name_fold, 'report') THEN 1 ELSE 2 END AS class, strlen(path) + 1 AS path_len {Q._FROM} WHERE NOT is_orphan AND contains(name_fold, 'report')),
p AS (SELECT regexp_extract(path, '(?s)^(.*[\\\\/])[^\\\\/]*\\z', 1) || regexp_replace(regexp_extract(path, '(?s)([^\\\\/]*)\\z', 1), '(?i)(report)', '[\\1]', 'g') || CASE WHEN is_dir THEN {_BS} ELSE '' END AS line, class, path_len, id FROM h ORDER BY class, path_len, id LIMIT 5),
n AS (SELECT count(*) AS n FROM h)
SELECT format('{{:,}}', n.n) || CASE WHEN n.n = 1 THEN ' result' ELSE ' results' END || coalesce(chr(10) || (SELECT string_agg(line, chr(10) ORDER BY class, path_len, id) FROM p), '') || CASE WHEN n.n > 5 THEN chr(10) || '... and ' || format('{{:,}}', n.n - 5) || ' more' ELSE '' END AS listing FROM n""",
    "excludes_file": Q._where(f"NOT is_dir AND contains(name_fold, 're') AND NOT contains(path_fold, 'cache') AND NOT contains(path_fold, {_BS} || 'users' || {_BS})"),
    "crawl_rules": f"""{Q._VOL}, x AS (SELECT id, CASE WHEN suffix(path, {_BS}) THEN lower(path) ELSE lower(path) || {_BS} END AS h FROM v)
SELECT id, CASE WHEN starts_with(h, concat('c:', {_BS}, 'users', {_BS})) THEN FALSE WHEN starts_with(h, concat('c:', {_BS})) THEN TRUE END AS include FROM x""",
    "shell_condition": Q._where(f"contains(name_fold, 're') AND {_LAB}"),
    "search_url": Q._where(f"contains(name_fold, 'st') AND {_LAB}"),
    "join_arguments": Q._where("NOT is_dir AND contains(name_fold, 're')"),
    "servable_paths": _list("path, ok", f"concat('C:', {_BS}, 'a'), TRUE", "'c:/a', TRUE", f"concat('D:', {_BS}, 'a'), FALSE", f"concat({_BS}, 'a'), TRUE", "'a', TRUE", "'', TRUE"),
    "request_caps": _list("asked, wanted, top, reserve", "0, 0, 0, 0", "50, 60, 50, 50", "10000000, 10000000, 100000, 100000", "-1, 5, 0, 0"),
    "usage_caps": _list("depth, asked, levels, shown", "0, 0, 1, 0", "3, 20, 3, 20", "1000, 1000000, 64, 10000"),
    "page_sizes": _list("term, shown, fetched", "'', 200, 1200", "'r', 200, 1200", "'re', 1000, 6000", "'rep', 5000, 30000", "'report', 5000, 30000"),
    "path_of_frn": f"{Q._VOL} SELECT id, path FROM v ORDER BY id DESC LIMIT 1",
    "clusters_with_commas": f"{Q._VOL} SELECT id, format('{{:,}}', CAST(size_bytes AS BIGINT)) AS shown FROM v",
    "seconds_shown": """SELECT s AS seconds, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS shown FROM range(100000) t(s)""",
    "paths_elided": _list(
        "path, width, start", *(f"replace('C:/users/import/report.txt', '/', {_BS}), {w}, {s}" for w, s in ((80, 0), (26, 0), (25, 2), (20, 8), (12, 15), (5, 15))), "'name', 2, 0", f"concat('C:', {_BS}, '目録', {_BS}, '表.txt'), 12, 5", f"concat('C:', {_BS}, 'e', chr(769), 't', {_BS}, 'x'), 5, 6"
    ),
    "absolute_paths": f"SELECT DISTINCT hit_id, CASE WHEN l = '' THEN '' ELSE concat('C:', {_BS}, 'lab', {_BS}, l) END AS path FROM (SELECT hit_id, regexp_extract(path, '(?s)([^\\\\/]*)\\z', 1) AS l FROM search_hit)",
    "nearest_ranks": _list("share, value", "0.0, 10", "0.5, 70", "0.9, 110", "0.99, 120", "1.0, 120", "0.25, NULL"),
    "status_report": Q._STATS + "SELECT 'ready' AS phase, (SELECT drive FROM volume_info) AS drive, greatest(0, (SELECT max(usn) + 1 FROM usn_event) - 100) AS lag, entries, files, orphans FROM s",
    "building_phase": _list("phase, entries, lag", "'building', 0, 0"),
    "recent_answers": _list("n, term, anew", "0, 'a', TRUE", "1, 'a', FALSE", "2, 'b', TRUE", "3, 'a', FALSE", "4, 'c', TRUE", "5, 'a', FALSE", "6, 'b', TRUE", "7, 'b', TRUE"),
    "discontinuities": _list("place, known, now, first, why", "5, 1, 1, 0, NULL", "5, 1, 1, 5, NULL", "5, 1, 1, 6, 'events were trimmed'", "5, 1, 2, 0, 'another journal'"),
    "page_rows": Q._PAGE + f""", g AS (SELECT * FROM pg ORDER BY CASE WHEN (SELECT count(*) FROM h) > 1000 THEN length(path) - length(translate(path, {_BS} || '/', '')) ELSE 0 END, rank_pos LIMIT 1000),
n AS (SELECT row_number() OVER (ORDER BY is_dir DESC, mtime DESC NULLS LAST, rank_pos) AS row_no, id FROM g) SELECT way, row_no, id FROM n, (VALUES ('on'), ('back')) AS w(way) WHERE row_no BETWEEN 11 AND 40""",
    "live_applied": _LIVE_ROWS,
    "live_replayed": _LIVE_ROWS,
    "live_garbage": _LIVE + "SELECT round(coalesce(sum(strlen(name)) FILTER (is_dead), 0) / greatest(sum(strlen(name)), 1), 9) AS ratio FROM nx",
    "live_measured": Q._VOL + f""", {Q._EV}, w AS (SELECT frn, min(usn) AS u FROM ev WHERE (e.r & 263) <> 0 AND (e.r & 512) = 0 AND (coalesce(e.a, 0) & 16) = 0 GROUP BY frn ORDER BY u, frn LIMIT 4096),
m AS (SELECT canon AS id, frn % 1000 + 1 AS c FROM w JOIN canon USING (frn)) SELECT v.id, v.sized OR m.id IS NOT NULL AS sized, CAST(coalesce(m.c, v.clusters) AS BIGINT) AS clusters FROM v LEFT JOIN m ON m.id = v.id""",
    "watch_recovers": Q._ENTRIES_SQL,
    "content_grouped": Q._LINES + r""", m AS (SELECT * FROM x WHERE regexp_matches(text, '(?i)lock\s+file|\bcursor\b')), w AS (SELECT rel_path, max(length(CAST(line_number AS VARCHAR))) AS w FROM m GROUP BY rel_path)
SELECT rel_path, string_agg(lpad(CAST(line_number AS VARCHAR), CAST(w AS INTEGER), ' ') || ': ' || regexp_replace(text, '(?i)(lock\s+file|\bcursor\b)', '[\1]', 'g'), chr(10) ORDER BY line_number) AS shown FROM m JOIN w USING (rel_path) GROUP BY rel_path""",
    "content_refreshed": Q._LINES + "SELECT * FROM x WHERE contains(lower(text), 'lock file')",
}
for _name, _group in (("type_audio", "audio music"), ("type_archive", "zip archive compressed"), ("type_document", "doc document"), ("type_code", "code source")):
    ORACLE[_name] = Q._where(f"ext IN {tuple(GROUPS[_group].split())}")
