"""Volumes, search, ranking, usage, views, content, journals and snapshots on small trees."""

import bisect
import os
import random

import pytest
from pyspark.sql import functions as F

from treesift import runtime
from treesift import schema as S
from treesift.functions import fold, highlight
from treesift.functions import text as X
from treesift.operators import content, journal, live, usage, view
from treesift.operators import volume as V
from treesift.plans import conditions
from treesift.sources import sinks, snapshot
from treesift.sources.volumes import MemoryVolume
from treesift.streaming import journal as streaming
from treesift.streaming.journal import Watched

D, L = S.A_DIRECTORY, S.A_REPARSE
#: ord, frn, parent_frn, name, attributes
SAMPLE = [
    (0, 5, 5, "", D), (1, 10, 5, "Windows", D), (2, 11, 10, "System32", D), (3, 12, 11, "kernel32.dll", 0), (4, 13, 5, "readme.txt", 0), (5, 14, 10, "README.MD", 0), (6, 12, 10, "kernel copy.dll", 0), (7, 15, 404, "lost.txt", 0), (8, 16, 5, "junction", D | L),
]
SIZED = [(12, 3, False), (13, 5, False), (14, 4294967295, True)]


def make(spark, records, sizes=()):
    m = MemoryVolume(spark, list(records), list(sizes))
    return V.build_entries(m.records(), m.sizes(), "C", 4096)


@pytest.fixture(scope="module")
def sample(spark):
    return make(spark, SAMPLE, SIZED)


def ids(volume, text, **options):
    return sorted(r["id"] for r in V.search(volume, text, **options)[0].select("id").collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", [1, 2, 3, 4, 5, 6, 8]), ("readme", [4, 5]), ("case:README", [5]), ("kernel", [3, 6]), ("wfn:readme.md", [5]), ("ww:kernel", [6]), ("*.dll", [3, 6]), ("path:windows", [1, 2, 3, 5, 6]), ("path:system32\\", [3]), ("ext:md", [5]), ("folder:", [1, 2, 8]), ("file:", [3, 4, 5, 6]),
        ("root:", [1, 4, 8]), ("empty:", [3, 8]), ("size:>16kb", [4, 5]), ("size:0", [1, 2, 3, 8]), ("parents:1", [2, 5, 6]), ("childcount:>0", [1, 2]), ("childfilecount:2", [1]), ("child:kernel", [1, 2]), ("!child:kernel folder:", [8]), ("attrib:l", [8]), ("len:>10", [3, 6]),
        ("regex:^k.*l$", [3, 6]), ("regex:^k.*[0-9]\\.", [3]), ("pathregex:system32", [2, 3]), ("regex:(?=k)", []), ("kernel | readme !md", [3, 4, 6]), ("path:c", [1, 2, 3, 4, 5, 6, 8]), ("!path:", []), ("size:<18446744073709551615", [1, 2, 3, 4, 5, 6, 8]), ("len:9..1", []),
    ],
)
def test_predicates(sample, text, want):
    assert ids(sample, text) == want


def test_sizes_lie_on_the_last_record(sample):
    got = {r["id"]: (r["clusters"], r["sized"]) for r in sample.entries.collect()}
    assert got[3] == (0, False) and got[6] == (3, True)


def test_orphans_and_flags(sample):
    assert ids(sample, "lost") == [] and ids(sample, "lost", include_orphans=True) == [7]
    assert ids(sample, "README", case_sensitive=True) == [5] and ids(sample, "path:WINDOWS", case_sensitive=True) == [1, 2, 3, 5, 6]
    assert {r["id"]: r["path"] for r in sample.entries.where("id in (0, 3, 7)").collect()} == {0: "C:\\", 3: "C:\\Windows\\System32\\kernel32.dll", 7: "<orphan>\\lost.txt"}
    assert sorted(r["id"] for r in V.search_literal(sample, "e.m").collect()) == [5]


def test_fold_knows_sigma(spark):
    v = make(spark, [(0, 5, 5, "", D), (1, 10, 5, "ΟΔΟΣ", 0), (2, 11, 5, "ẞx", 0)])
    assert ids(v, "οδοσ") == [1] and ids(v, "ΟΔΟΣ") == [] and ids(v, "ßX") == [2]
    assert fold.fold_text("İΣ") == "i̇σ"


def test_glob_counts_characters(spark):
    v = make(spark, [(0, 5, 5, "", D), (1, 10, 5, "日本.txt", 0), (2, 11, 5, "🐈.png", 0), (3, 12, 5, "a%b_c", 0), (4, 13, 5, "x.txt\n", 0)])
    assert [ids(v, q) for q in ("??.txt", "?.png", "??.png", "日*t", "%", "a?b?c", "*.txt")] == [[1], [2], [], [1], [3], [3], [1]]


def test_cycles_end(spark):
    v = make(spark, [(0, 5, 5, "", D), (1, 10, 11, "a", D), (2, 11, 10, "b", D), (3, 12, 11, "c", 0), (4, 13, 13, "self", D), (5, 14, 13, "kid", 0)])
    assert ids(v, "") == [] and ids(v, "", include_orphans=True) == [1, 2, 3, 4, 5]
    assert v.entries.where("id = 5").first()["path"] == "<orphan>\\self\\kid"


def test_dupes_have_known_multiplicity(spark):
    rows, n = [(0, 5, 5, "", D)], 1
    for i in range(40):
        for k in range(i % 4):
            rows.append((n, 100 + n, 5, f"N{i}.x" if k else f"n{i}.X", 0))
            n += 1
    v = make(spark, rows)
    assert len(ids(v, "dupe:")) == sum(i % 4 for i in range(40) if i % 4 > 1)


def test_random_trees_against_brute_force(spark):
    r = random.Random(7)
    names = ["a.txt", "Ab", "b.RS", "cab", "log", "app.log", "x y"]
    rows = [(0, 5, 5, "", D)] + [(i, 100 + i, r.choice([5, 5, *range(101, 100 + i)]) if i > 1 else 5, r.choice(names), D if i % 3 else 0) for i in range(1, 60)]
    v = make(spark, rows, [(100 + i, i % 5, False) for i in range(1, 60)])
    got = {x["id"]: x for x in v.live.collect()}
    kids = {i: [c for c in got.values() if c["parent_id"] == i] for i in got}
    for q, test in {"ab !log": lambda e: "ab" in e["name"].lower() and "log" not in e["name"].lower(), "ww:log": lambda e: e["name"] in ("log", "app.log"), "childcount:2..3": lambda e: 2 <= len(kids[e["id"]]) <= 3, "child:cab | size:8kb": lambda e: any("cab" in c["name"] for c in kids[e["id"]]) or e["clusters"] == 2}.items():
        assert ids(v, q) == sorted(i for i, e in got.items() if test(e)), q


def rank_tree(spark):
    rows = [(0, 5, 5, "", D), (1, 10, 5, "report", D)] + [(i, 20 + i, p, n, 0) for i, p, n in ((2, 5, "my report"), (3, 10, "report"), (4, 5, "reports.txt"), (5, 10, "a report"), (6, 10, "report2"))]
    return make(spark, rows)


def test_rank_order_and_limits(spark):
    v = rank_tree(spark)
    hits, q = V.search(v, "REPORT")
    order = lambda **k: [r["id"] for r in V.top_ranked(hits, q, **k).orderBy("rank_pos").collect()]
    assert order(limit=10) == [1, 3, 4, 6, 2, 5]
    assert order(limit=3) == [1, 3, 4] and order(limit=4, reserve=2) == [1, 3, 2, 5] and order(limit=4, reserve=9) == [1, 3, 2, 5] and order(limit=2, reserve=9) == [2, 5]
    hits, q = V.search(v, "report count:2")
    assert [r["id"] for r in V.top_ranked(hits, q, 10).orderBy("rank_pos").collect()] == [1, 3]


@pytest.mark.parametrize("seed", range(3))
def test_reservation_equals_dropping_from_the_back(spark, seed):
    r = random.Random(seed)
    rows = [(0, 5, 5, "", D)] + [(i, 100 + i, 5, r.choice(["key", "key1", "a key"]) + "x" * r.randrange(4), 0) for i in range(1, 30)]
    v = make(spark, rows)
    hits, q = V.search(v, "key")
    whole = [(x["class"], x["id"]) for x in V.top_ranked(hits, q, 1000).orderBy("rank_pos").collect()]
    for limit, reserve in ((5, 2), (10, 10), (12, 3), (40, 5)):
        kept, inside = whole[:limit], [x for x in whole if x[0] == 2]
        missing = min(reserve, limit, len(inside)) - sum(x[0] == 2 for x in kept)
        if missing > 0:
            kept = [x for x in kept if x[0] != 2][: max(0, sum(x[0] != 2 for x in kept) - missing)] + [x for x in kept if x[0] == 2]
            kept += [x for x in inside if x not in kept][:missing]
        got = [x["id"] for x in V.top_ranked(hits, q, limit, reserve).orderBy("rank_pos").collect()]
        assert got == [x[1] for x in sorted(kept, key=whole.index)]


def usage_tree(spark):
    rows = [(0, 5, 5, "", D), (1, 10, 5, "a", D), (2, 11, 10, "b", D), (3, 12, 11, "f", 0), (4, 13, 10, "g", 0), (5, 14, 5, "h", 0), (6, 15, 5, "big", 0), (7, 16, 404, "o", 0)]
    return make(spark, rows, [(12, 3, True), (13, 5, False), (14, 2, False), (15, 10, False), (16, 99, False)])


def test_usage(spark, rows):
    v = usage_tree(spark)
    assert rows(usage.usage_report(v, 0, 1, 10).select("id", "clusters", "truncated")) == [(1, 8, True), (5, 2, False), (6, 10, False)]
    assert [r["id"] for r in usage.usage_report(v, 0, 2, 3).collect()] == [6, 1, 4]
    assert rows(usage.usage_report(v, 1, 1, 10).select("id", "depth", "clusters")) == [(2, 1, 3), (4, 1, 5)]
    assert usage.usage_total(v, 0).first()["clusters"] == 20 and tuple(usage.usage_total(v, 1).first()) == (8, True)
    dead = V.Volume(v.entries.withColumn("is_dead", F.col("id") == 2), "C", 4096, 0)
    assert usage.usage_total(dead, 1).first()["clusters"] == 8  # children still count through a dead parent
    stats = V.statistics(v).first()
    assert (stats["entries"], stats["unsized_files"], stats["orphans"]) == (8, 0, 1)
    assert V.resolve_path(v, "c:/A/B").first()["id"] == 2 and V.resolve_path(v, "D:\\a").first() is None and V.resolve_path(v, "C:\\").first()["id"] == 0
    assert V.path_of_frn(v, 12).first()["path"] == "C:\\a\\b\\f"
    assert V.status(v, 5, 3).first()["lag"] == 0 and V.tombstone_ratio(dead).first()[0] > 0
    assert not V.size_shortfall(V.statistics(v)).first()["warn"]


def test_size_parts(spark, rows):
    parts = spark.createDataFrame([(1, None, 5, False), (2, 1, 7, False), (3, 9, 4, False), (4, None, 4294967295, False), (5, 4, 1, None)], "frn long, base_frn long, clusters long, truncated boolean")
    assert rows(V.merge_size_parts(parts)) == [(1, 12, False), (4, 4294967295, True)]
    runs = spark.sql("select array(named_struct('length', 5L, 'sparse', false), named_struct('length', 9L, 'sparse', true)) as r")
    assert runs.select(V.run_clusters(F.col("r"))).first()[0] == 5


def test_empty_volume(spark):
    v = V.empty_volume(spark, "X")
    assert v.entries.count() == 1 and ids(v, "") == [] and usage.usage_total(v, v.root_id).first()["clusters"] == 0


HITS = [("C:\\a\\x.txt", False, "2026-01-02", 1), ("C:\\x.txt", False, None, 2), ("C:\\b\\X.TXT", False, "2026-01-05", 3), ("C:\\d", True, None, 4), ("C:\\a\\b\\x.txt", False, "2026-01-01", 5)]


def test_view(spark):
    hits = spark.createDataFrame(HITS, "path string, is_dir boolean, mtime string, rank_pos int").withColumn("mtime", F.to_timestamp("mtime"))
    page = view.page_of(hits, 5, "abc")
    assert [r["rank_pos"] for r in page.orderBy("row_no").collect()] == [4, 3, 1, 5, 2]
    assert [r["rank_pos"] for r in view.fetch_rows(page, 2, 2).orderBy("row_no").collect()] == [3, 1] and view.fetch_rows(page, 5, 9).count() == 1 and view.fetch_rows(page, 3, -2).count() == 2
    assert view.page_of(hits, 600_000, "abc").count() == 4 and view.page_of(hits, 5, "abc", "c:\\a", ["\\b\\"]).count() == 1
    assert [r["rank_pos"] for r in view.near_first(hits, 3).orderBy("separators", "rank_pos").collect()] == [2, 4, 1]
    props = view.row_properties(page.withColumn("size_bytes", F.lit(7)).withColumn("attributes", F.lit(None).cast("int"))).orderBy("row_id").collect()
    assert (props[0]["item_type"], props[0]["size"], props[1]["item_type"], props[1]["folder_display"], props[0]["rank"]) == ("Directory", None, ".TXT", "C:\\b", 999_999)


def test_rules(spark):
    rule = view.rule_from_url("file:///C:\\[05816791-b272]\\Users\\*\\AppData\\", False)
    assert rule == view.Rule("c:\\users\\*\\appdata\\", False) and view.rule_from_url("winrt://x", True) is None
    rules = [view.Rule("c:\\", True), rule, view.Rule("c:\\programdata\\", False), view.Rule("c:\\programdata\\start menu", True), view.Rule("*\\$recycle.bin\\", False), view.Rule("c:\\windows.*\\", False)]
    cases = {"c:\\users\\me\\appdata\\x": False, "c:\\users\\me\\deep\\appdata": True, "c:\\programdata\\y": False, "c:\\programdata\\start menu\\y": True, "d:\\$recycle.bin\\z": False, "c:\\windows.old": False, "c:\\windows": True, "e:\\x": None}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", view.rule_verdict(F.col("p"), rules).alias("v")).collect()
    assert {r["p"]: r["v"] for r in got} == cases


def test_content(spark, rows):
    texts = spark.createDataFrame([("a\\1", "x\nNeedle one\r\nneedle two\n", False), ("b\\2", "needle", True), ("a\\3", None, False), ("a\\4", "", False)], "rel_path string, text string, is_binary boolean")
    assert rows(content.grep(texts, "needle")) == [("a\\1", 2, "Needle one"), ("a\\1", 3, "needle two")]
    assert rows(content.grep(texts, "needle", insensitive=False)) == [("a\\1", 3, "needle two")]
    assert content.grep(texts, "", root="r", scopes=["r\\b"]).count() == 0 and rows(content.file_counts(content.grep(texts, "needle"))) == [("a\\1", 2)]
    assert rows(content.grep(texts, "^$")) == [("a\\4", 1, "")]
    index = content.trigram_index(texts)
    for word in ("needle", "NEEDLE T", "ne", "absent"):
        assert rows(content.grep_indexed(texts, index, word)) == rows(content.grep(texts, word))
    with pytest.raises(ValueError, match="outside"):
        content.in_scopes(F.col("rel_path"), "r", ["q\\x"])
    with pytest.raises(ValueError, match="not a pattern"):
        content.grep(texts, "(")
    assert sinks.grouped_lines(content.grep(texts, "needle")).first()["lines"] == ["2: Needle one", "3: needle two"]


def test_index_keeps_one_row_a_text_and_is_refreshed(spark, rows):
    long = "".join(f"{i:x} " for i in range(20_000))
    then = [("a", "the lock file"), ("b", "gone lock file"), ("c", "a key"), ("d", long), ("e", None), ("f", ""), ("g", "lo"), ("h", "\U0001f600 Lock File é\n目録の表 lock files")]
    now = [("a", "no more of it"), ("c", "Lock\nFILE"), ("c", "LOCK FILE"), ("d", long + "lock file"), ("e", "lock file"), ("f", ""), ("g", "lo"), then[-1]]
    before, after = (spark.createDataFrame(t, "rel_path string, text string") for t in (then, now))
    kept = content.sealed_index(before)
    assert sorted(r["rel_path"] for r in kept.collect()) == ["a", "b", "c", "d", "f", "g", "h"]
    assert kept.agg(F.sum(F.size("grams") * 8)).first()[0] < sum(len(t or "") for _, t in then)
    index = content.refresh_index(kept, after)
    assert index.count() == 8 and rows(content.refresh_index(index, after)) == rows(content.sealed_index(after))
    for word in ("Lock File", "lo", "目録の", "\U0001f600 l", "1f 20", "4e1f lock", "absent", "É"):
        assert rows(content.grep_indexed(after, index, word)) == rows(content.grep(after, word)), word
    assert rows(content.grep_indexed(after, index, "lock file").select("rel_path")) == [("c",), ("d",), ("e",), ("h",), ("h",)]
    assert rows(index.where(content.may_hold(F.col("grams"), "absent words")).select("rel_path")) == []


def test_regex_dialect():
    assert conditions.java_pattern("a$", True) == r"(?iuUd)a\z" and conditions.java_pattern("[$]", False) == "(?Ud)[$]"
    assert conditions.java_pattern(r"(?P<n>a)\$", False) == r"(?Ud)(?<n>a)\$" and conditions.java_pattern(r"(a)\1", True) is None and conditions.java_pattern("(?m)a$", True).endswith("a$")


def test_scalar_functions(spark):
    size = lambda n: spark.range(1).select(X.human_size(F.lit(n))).first()[0]
    assert [size(n) for n in (0, 1023, 1024, 3407872, 1 << 60)] == ["0.0 B", "1023.0 B", "1.0 KiB", "3.2 MiB", "1024.0 PiB"]
    assert [X.human_seconds(n) for n in (0, 61, 3600)] == ["0s", "1m 1s", "1h 0m 0s"]
    assert [X.percent_decode(t) for t in ("a%20b", "100%達成", "%41", "%4", "%zz", "%ff", "+")] == ["a b", "100%達成", "A", "%4", "%zz", "�", "+"]
    assert X.nearest_rank([1, 2, 3, 4], 0.5) == 3 and X.nearest_rank([1], 1.0) == 1 and X.nearest_rank([], 0.5) is None
    p = "C:\\alpha\\beta\\name.txt"
    assert [p[X.elide_from(p, w) :] for w in (99, 16, 12, 3)] == [p, "\\beta\\name.txt", "\\name.txt", "\\name.txt"]
    assert X.absolute_argument("x", "C:\\here") == "C:\\here\\x" and X.absolute_argument('C:"', "C:\\h") == 'C:"' and X.absolute_argument("", "C:\\h") == ""
    assert spark.range(1).select(X.share_percent(F.lit(1), F.lit(0)), X.with_commas(F.lit(1234567))).first()[:] == (0.0, "1,234,567")


def test_highlight(spark):
    assert highlight.query_spans("C:\\re\\Report re.txt", ["re"]) == [(6, 8), (13, 15)] and highlight.name_spans("aİ.txt", "ai") == [(0, 2)] and highlight.name_spans("x", "") == []
    assert highlight.query_spans("abcd", ["abc", "bcd"]) == [(0, 4)]
    df = spark.createDataFrame([("C:\\ab",), (None,)], "p string").select(highlight.spans_column(F.col("p"), "b").alias("s"))
    assert [r["s"] and [(x["start"], x["end"]) for x in r["s"]] for r in df.collect()] == [[(4, 5)], None]
    assert sinks.listing(spark.createDataFrame([("C:\\ab", True, 1)], "path string, is_dir boolean, rank_pos int"), 3, ["b"]) == "3 results\nC:\\a[b]\\\n... and 2 more"


def ev(usn, frn, parent, reason, name="n", attributes=0):
    return (usn, frn, parent, reason, name, attributes)


def test_parents_as_of_each_event(spark, rows):
    m = MemoryVolume(spark, [(1, 10, 5, "docs", D)], [], [ev(1, 20, 10, 0x100), ev(2, 21, 30, 0x100), ev(3, 30, 5, 0x100), ev(4, 10, 5, 0x200), ev(5, 22, 10, 0x100), ev(6, 23, 10, 0x100), ev(7, 10, 5, 0x100), ev(8, 23, 10, 0x2000), ev(9, 24, 5, 0x300), ev(9, 24, 5, 0x300), ev(10, 25, 5, 0x1000)])
    got = {r["frn"]: (r["parent_known"], r["born"] if r["born"] >= 0 else "base") for r in journal.parents_as_of(m.records(), m.journal()).collect()}
    assert got == {20: (True, 1), 21: (False, 2), 30: (True, 3), 22: (False, 5), 23: (True, 6), 10: (True, 7)}


def test_backlog(spark):
    events = [ev(i, 1000 + i // 2, 5, 0x100) for i in range(10_000)] + [ev(20_000, 7, 5, 0x2, attributes=D), ev(20_001, 8, 5, 0x302)]
    backlog = journal.size_backlog(MemoryVolume(spark, [], [], events).journal())
    assert backlog.count() == 5000
    taken = journal.next_to_measure(backlog)
    assert taken.count() == 4096 and taken.agg(F.max("frn")).first()[0] == 1000 + 4095
    new = journal.record_sizes(spark.createDataFrame([(1, 2, True)], S.SIZES), spark.createDataFrame([(1, 9, False), (2, 1 << 33, False)], S.SIZES))
    assert sorted(tuple(r) for r in new.collect()) == [(1, 9, False), (2, S.MAX_CLUSTERS, True)]


def test_watch_follows_and_recovers(spark, tmp_path):
    m = MemoryVolume(spark, [(0, 5, 5, "", D), (1, 10, 5, "docs", D), (2, 11, 10, "a.txt", 0)], [(11, 4, False)], [])
    w = Watched.build(m)
    m.events = [ev(1, 12, 10, 0x100, "b.txt"), ev(2, 11, 10, 0x2000, "c.txt"), ev(3, 12, 10, 0x200), ev(4, 13, 10, 0x100, "d.txt")]
    assert w.sync() is None and w.cursor == 5
    assert sorted((r["id"], r["path"]) for r in w.volume.live.collect()) == [(1, "C:\\docs"), (2, "C:\\docs\\c.txt"), (3, "C:\\docs\\d.txt")]
    assert w.volume.entries.where("id = 2").first()["clusters"] == 4 and w.sync() is None
    m.journal_id = 2
    assert w.sync() == "another journal"
    m.record_rows = [(0, 5, 5, "", D), (1, 10, 5, "new", D)]
    w.recover()
    assert [r["path"] for r in w.volume.live.collect()] == ["C:\\new"] and w.journal_id == 2
    m.trimmed_before = 100
    assert w.sync() == "events were trimmed"
    w.save(str(tmp_path / "snap"))
    back = snapshot.load(spark, str(tmp_path / "snap"), "E")
    assert back.volume.entries.count() == 2 and back.volume.drive == "E" and snapshot.resumable(back, 2, 0) and not snapshot.resumable(back, 3, 0)


def test_snapshot_rejects_others(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshot.load(spark, str(tmp_path / "none"))
    (tmp_path / "manifest.json").write_text('{"format": "other"}')
    with pytest.raises(ValueError, match="another kind"):
        snapshot.load(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text("junk")
    with pytest.raises(ValueError, match="no manifest"):
        snapshot.load(spark, str(tmp_path))


def test_paths_sink(spark, sample, tmp_path):
    hits, q = V.search(sample, "readme")
    sinks.write_paths(V.top_ranked(hits, q, 10), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["C:\\readme.txt", "C:\\Windows\\README.MD"]


def test_dead_folders_keep_their_place(spark):
    m = MemoryVolume(spark, [(1, 10, 5, "dir", D), (2, 11, 10, "f", 0), (3, 12, 10, "g", 0), (4, 12, 5, "link to g", 0)], [(11, 4, False)], [])
    w = Watched.build(m)
    root = w.volume.root_id
    m.events = [ev(1, 10, 5, 0x200), ev(2, 12, 5, 0x2000, "moved"), ev(3, 20, 10, 0x100, "late"), ev(4, 10, 5, 0x100, "again", D), ev(5, 21, 10, 0x100, "inside")]
    assert w.sync() is None and w.volume.root_id == root
    got = {r["id"]: (r["path"], r["is_dead"], r["is_orphan"], r["sized"]) for r in w.volume.entries.where(F.col("id") != root).collect()}
    assert got == {
        1: ("C:\\dir", True, False, False), 2: ("C:\\dir\\f", False, False, True), 3: ("C:\\dir\\g", False, False, False), 4: ("C:\\moved", False, False, False),
        root + 1: ("<orphan>\\late", False, True, False), root + 2: ("C:\\again", False, False, False), root + 3: ("C:\\again\\inside", False, False, False),
    }
    assert V.tombstone_ratio(w.volume).first()[0] > 0
    before = sorted(tuple(r) for r in w.volume.entries.collect())
    w.cursor = 0
    again = live.apply_events(w.volume, m.journal(), 5)
    assert sorted(tuple(r) for r in again.entries.where("not is_dead").select("path").collect()) == sorted((r[17],) for r in before if not r[10])


def test_many_dead_names_are_compacted(spark):
    m = MemoryVolume(spark, [(i, 10 + i, 5, f"name {i}", 0) for i in range(10)], [], [])
    w = Watched.build(m)
    m.events = [ev(i, 10 + i, 5, 0x200) for i in range(6)]
    m.record_rows = m.record_rows[6:]
    assert w.run(2, seconds=0) == ["many names are dead", "synced"] and w.volume.entries.count() == 5


def test_files_are_measured_as_they_change(spark, monkeypatch):
    monkeypatch.setattr(journal, "MEASURED_AT_ONCE", 2)
    monkeypatch.setattr(journal.next_to_measure, "__defaults__", (2,))
    m = MemoryVolume(spark, [(i, 10 + i, 5, f"f{i}", 0) for i in range(4)], [(10, 1, False)], [])
    w = Watched.build(m)
    m.live_rows = [(10, 7, False), (11, 1 << 40, False), (12, 3, False)]
    m.events = [ev(1, 10, 5, 0x2), ev(2, 11, 5, 0x2), ev(3, 12, 5, 0x2), ev(4, 13, 5, 0x2)]
    assert w.sync() is None and w.backlog.count() == 2
    sizes = lambda: {r["frn"]: (r["clusters"], r["size_truncated"], r["sized"]) for r in w.volume.live.collect()}
    assert sizes()[10] == (7, False, True) and sizes()[11] == (S.MAX_CLUSTERS, True, True) and sizes()[12] == (0, False, False)
    assert w.sync() is None and w.backlog.count() == 0 and sizes()[12] == (3, False, True) and sizes()[13] == (0, False, False)


def test_resume_from_a_snapshot(spark, tmp_path):
    m = MemoryVolume(spark, [(1, 10, 5, "dir", D), (2, 11, 10, "f", 0)], [], [])
    w = Watched.build(m)
    w.save(str(tmp_path))
    w.save(str(tmp_path))
    assert len(list(tmp_path.glob("manifest-*.json"))) == 2
    m.drive, m.size_rows, m.events = "E", [(11, 9, False)], [ev(1, 12, 10, 0x100, "new")]
    back = Watched.resume(m, str(tmp_path))
    assert back.sync() is None and {r["path"]: r["clusters"] for r in back.volume.live.collect()} == {"E:\\dir": 0, "E:\\dir\\f": 9, "E:\\dir\\new": 0}
    assert V.resolve_path(back.volume, "e:/dir").count() == 1 and back.cursor == 2
    m.record_rows, m.journal_id = [(7, 11, 5, "other", 0)], 2
    assert [r["path"] for r in Watched.resume(m, str(tmp_path)).volume.live.collect()] == ["E:\\other"]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(streaming, "COMPACT_AFTER", 3)
    events = tmp_path / "events"
    put = lambda n, data: spark.createDataFrame(data, S.JOURNAL).selectExpr("*", "CAST(NULL AS timestamp) AS ts", "CAST(NULL AS timestamp) AS read_at").coalesce(1).write.mode("append").parquet(str(events))
    want = {}
    for n in range(8):
        put(n, [ev(n * 10, n % 5, 5, 0x100), ev(n * 10 + 1, 100 + n, 5, 0x200)])
        want[n % 5], want[100 + n] = (n % 5, n * 10, False, 5), (100 + n, n * 10 + 1, True, 5)
        table = streaming.stream_state(spark, str(events), str(tmp_path / "state"))
        assert rows(table.read()) == sorted(want.values())
    assert table.version == 7 and len(list((tmp_path / "state" / "table").glob("base-*"))) <= 2
    assert rows(streaming.StateTable(spark, table.folder).read()) == sorted(want.values())


def test_a_followed_volume_leaves_no_folders_behind(spark):
    m = MemoryVolume(spark, [(1, 10, 5, "dir", D)], [], [])
    w = Watched.build(m)
    counts = []
    for n in range(4):
        m.events = [*m.events, ev(n * 2 + 1, 20 + n, 10, 0x100, f"f{n}")]
        assert w.sync() is None and w.volume.live.count() == n + 2
        with runtime.scratch() as made:
            pass
        counts.append(len(os.listdir(runtime.shared_folder(spark).removeprefix("file:"))))
        assert made == []
    assert counts[-1] == counts[-2]


def test_blocks_by_many_cuts(spark):
    cuts = list(range(0, 10_230, 10))
    got = spark.range(-5, 10_300, 7).select("id", runtime.block_of(F.col("id"), cuts).alias("b")).collect()
    assert all(r["b"] == bisect.bisect_right(cuts, r["id"]) for r in got)
    assert spark.sql("SELECT CAST(NULL AS long) AS id").select(runtime.block_of(F.col("id"), cuts).alias("b")).first()["b"] == 0
