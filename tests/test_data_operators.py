"""Change folds, orphan references and parent-link forests against brute force, with nulls, ties, repeats and empty tables."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from treesift import queries_data, runtime
from treesift.operators import changes, hierarchy, references

EV = "usn long, frn long, parent_frn long, reason long, note string"


def in_order(found):
    return sorted(found, key=lambda t: [(x is None, 0 if x is None else x) for x in t])


def state_by_hand(events):
    out = {}
    for usn, frn, parent, reason, _ in events:
        if usn is None or frn is None:
            continue
        r = reason or 0
        deleted = bool(r & 0x200)
        if not (deleted or (r & 0x2100 and not (r & 0x1000 and not r & 0x2000))):
            continue
        key = (usn, deleted, parent is not None, parent or 0)
        if frn not in out or key > out[frn][0]:
            out[frn] = (key, (frn, usn, deleted, parent))
    return in_order(v[1] for v in out.values())


def feed(n, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(40)]), r.choice([None, 1, 1, 1, 2, 3, 4, 5]), r.choice([None, 7, 8]), r.choice([None, 0x100, 0x200, 0x300, 0x1000, 0x2000, 0x3000, 0x2, 0x80000100]), "x") for _ in range(n)]
    return rows + rows[: n // 3]


@pytest.mark.parametrize("seed", range(4))
def test_fold_matches_brute_force_in_any_order(spark, rows, seed):
    events = feed(60, seed)
    want = state_by_hand(events)
    for order in (events, events[::-1]):
        assert rows(changes.journal_state(spark.createDataFrame(order, EV))) == want


def test_fold_in_parts_equals_fold_at_once(spark, rows):
    events = feed(80, 9)
    whole = changes.journal_state(spark.createDataFrame(events, EV))
    first = changes.journal_state(spark.createDataFrame(events[40:], EV))
    assert rows(changes.journal_state(spark.createDataFrame(events[:40], EV), first)) == rows(whole)


def test_a_tombstone_stays_against_late_changes(spark, rows):
    state = changes.journal_state(spark.createDataFrame([(9, 1, 5, 0x200, "")], EV))
    later = changes.journal_state(spark.createDataFrame([(3, 1, 6, 0x100, "")], EV), state)
    assert rows(later) == [(1, 9, True, 5)] and changes.current_rows(later).count() == 0


def test_empty_feed_and_base(spark, rows):
    none = spark.createDataFrame([], EV)
    assert rows(changes.journal_state(none)) == []
    base = spark.createDataFrame([(2, 4, 9), (7, 4, 8), (None, 4, 8)], "ord long, frn long, parent_frn long")
    got = changes.journal_state(none, changes.records_as_base(base))
    assert [(r["frn"], r["parent_frn"], r["deleted"]) for r in got.collect()] == [(4, 8, False)]


RECORDS = [(1, 10, 5, "a"), (1, 10, 5, "again"), (2, 11, 10, "b"), (3, 12, 99, "missing"), (4, 13, 50, "deleted"), (5, 14, 60, "late"), (6, 15, None, "null"), (None, 16, 99, "no ord"), (7, 17, 17, "self"), (8, 10, 99, "second record")]
FEED = [(1, 50, 5, 0x100, ""), (2, 50, 5, 0x200, ""), (3, 60, 5, 0x100, ""), (4, 10, 5, 0x2000, "")]


@pytest.mark.parametrize(("most", "bits"), [(8, 1 << 26), (8, 16), (0, 1 << 26)])
def test_record_orphans_with_one_filter_several_and_none(spark, rows, most, bits, monkeypatch):
    monkeypatch.setattr(references, "MAX_FILTERS", most)
    monkeypatch.setattr(references, "FILTER_BITS", bits)
    records = spark.createDataFrame([(*r, None) for r in RECORDS], "ord long, frn long, parent_frn long, name_utf16 string, seen_at timestamp").withColumn("why", F.lit("clash"))
    got = references.record_orphans(records, spark.createDataFrame(FEED, EV), F.lit(5))
    assert rows(got.select("row_key", "why")) == [(3, "missing"), (4, "deleted"), (5, "late"), (8, "missing")]


def test_entry_orphans(spark, rows):
    t = lambda s: f"2026-01-01 00:00:{s:02}"
    data = [(1, 0, 1, t(5)), (1, 0, 1, t(5)), (2, 1, 0, t(1)), (3, 1, 0, t(9)), (4, 1, 0, None), (5, 77, 0, t(1)), (6, 7, 0, t(1)), (7, 0, 8, t(1)), (8, 77, 8, t(1)), (9, None, 0, t(1)), (10, 4294967294, 0, t(1)), (11, 4, 0, t(1)), (12, 77, None, None)]
    entries = spark.createDataFrame(data, "id long, parent long, flags int, added_at string").withColumn("added_at", F.to_timestamp("added_at"))
    got = references.entry_orphans(entries, F.lit(0))
    assert rows(got.select("row_key", "why")) == [(2, "late"), (5, "missing"), (6, "deleted"), (12, "missing")]
    assert references.entry_orphans(entries.limit(0), F.lit(0)).count() == 0
    counted = references.count_by_period(got.withColumn("tab", F.lit("entry")))
    assert sum(r["n"] for r in counted.collect()) == 4


def forest_by_hand(parent, root):
    out = {}
    for node in parent:
        seen, x = [], node
        while True:
            seen.append(x)
            p = parent[x]
            if p == root:
                out[node] = (root, len(seen) - 1)
                break
            if p is None or p not in parent:
                out[node] = (x, len(seen) - 1)
                break
            if p in seen:
                out[node] = (min(seen[seen.index(p) :]), -1)
                break
            x = p
    return in_order((n, parent[n], *v) for n, v in out.items())


def random_links(n, seed):
    r = random.Random(seed)
    nodes = r.sample(range(100, 100 + 3 * n), n)
    chain = {a: b for a, b in itertools.pairwise(nodes[: n // 2])}
    return {x: chain.get(x) if x in chain else r.choice([None, 5, 5, r.choice(nodes), r.choice(nodes), x, 999_999]) for x in nodes}


@pytest.mark.parametrize(("n", "seed", "merge_rows"), [(60, 1, 1000), (60, 2, 5), (40, 3, 3), (200, 4, 20), (1, 5, 1), (30, 6, 2)])
def test_forest_matches_brute_force_at_any_level(spark, rows, n, seed, merge_rows):
    parent = random_links(n, seed)
    links = runtime.materialise(spark.createDataFrame(list(parent.items()), "node long, parent long"))
    got = hierarchy.resolve_forest(links, F.lit(5).cast("long"), merge_rows)
    assert rows(got) == forest_by_hand(parent, 5)


def test_long_cycle_across_tasks(spark, rows):
    ring = {i: i % 20 + 1 for i in range(1, 21)} | {30: 7, 31: 30}
    links = runtime.materialise(spark.createDataFrame(list(ring.items()), "node long, parent long"))
    got = hierarchy.resolve_forest(links, F.lit(0).cast("long"), 2)
    assert {tuple(r)[2:] for r in got.collect()} == {(1, -1)}


@pytest.mark.parametrize("bytes_", [1 << 28, 0])
def test_paths_descendants_and_totals(spark, rows, monkeypatch, bytes_):
    monkeypatch.setattr(hierarchy, "CHAIN_BYTES", bytes_)
    data = [(1, 5, "a"), (2, 1, "b"), (3, 2, None), (4, 99, "x"), (6, 4, "y"), (7, 8, "p"), (8, 7, "q"), (9, None, "n")]
    links = runtime.materialise(spark.createDataFrame(data, "node long, parent long, name string"))
    root = F.lit(5).cast("long")
    forest = runtime.materialise(hierarchy.resolve_forest(links.select("node", "parent"), root))
    paths = {r["node"]: r["path"] for r in hierarchy.materialise_paths(links, forest, root, "C:").collect()}
    assert paths == {1: "C:\\a", 2: "C:\\a\\b", 3: "C:\\a\\b\\", 4: "<orphan>\\x", 6: "<orphan>\\x\\y", 7: None, 8: None, 9: "<orphan>\\n"}
    assert rows(hierarchy.descendants(links, forest, root)) == [(1, 2, 1), (1, 3, 2), (2, 3, 1), (4, 6, 1)]
    assert rows(hierarchy.subtree_totals(links, forest, root, {"n": F.count(F.lit(1))})) == [(1, 2), (2, 1), (4, 1)]


def test_empty_forest(spark):
    links = runtime.materialise(spark.createDataFrame([], "node long, parent long"))
    assert hierarchy.resolve_forest(links, F.lit(5).cast("long")).count() == 0


def test_links_of_records_and_entries(spark, rows):
    records = spark.createDataFrame([(1, 10, 5, "old"), (9, 10, 6, "new"), (9, 10, 6, "new"), (2, None, 5, "x")], "ord long, frn long, parent_frn long, name_utf16 string")
    assert rows(hierarchy.record_links(records)) == [(10, 6, "new")]
    entries = spark.createDataFrame([(1, 4294967294, "a"), (1, 4294967294, "a"), (2, 1, None)], "id long, parent long, name string")
    assert rows(hierarchy.entry_links(entries)) == [(1, None, "a"), (2, 1, None)]


def pairs_below_cycles_by_hand(parent, root):
    ring = set()
    for node in parent:
        x = parent[node]
        for _ in parent:
            if x == node:
                ring.add(node)
            x = parent.get(x) if x != root else None
    out = []
    for node in parent:
        x, distance = node, 0
        while x not in ring and parent[x] != root and parent[x] in parent:
            x, distance = parent[x], distance + 1
            out.append((x, node, distance))
    return sorted(out), ring


@pytest.mark.parametrize(("seed", "bytes_", "merge_rows"), [(1, 1 << 28, 2_000_000), (2, 1 << 28, 3), (3, 0, 2_000_000), (4, 0, 3)])
def test_trees_below_cycles_have_descendants(spark, rows, monkeypatch, seed, bytes_, merge_rows):
    monkeypatch.setattr(hierarchy, "CHAIN_BYTES", bytes_)
    monkeypatch.setattr(hierarchy, "MERGE_ROWS", max(merge_rows, 1 if bytes_ else 0))
    parent = random_links(60, seed) | {1: 2, 2: 3, 3: 1, 10: 2, 11: 10, 12: 11, 13: 10, 20: 20, 21: 20}
    want, ring = pairs_below_cycles_by_hand(parent, 5)
    assert {1, 2, 3, 20} <= ring and {(2, 12, 3), (20, 21, 1)} <= set(want)
    links = runtime.materialise(spark.createDataFrame(list(parent.items()), "node long, parent long"))
    root = F.lit(5).cast("long")
    forest = runtime.materialise(hierarchy.resolve_forest(links, root))
    assert {r["node"] for r in hierarchy.ring_nodes(forest).collect()} == ring
    assert rows(hierarchy.descendants(links, forest, root)) == want
    circular = {r["node"] for r in forest.where("depth < 0").collect()}
    assert rows(hierarchy.marked_descendants(links, forest, root)) == [(*p, p[1] in circular) for p in want]
    counts = {a: sum(p[0] == a for p in want) for a, _, _ in want}
    assert rows(hierarchy.subtree_totals(links, forest, root, {"n": F.count(F.lit(1))})) == sorted(counts.items())


@pytest.mark.parametrize("seed", [5, 6])
def test_counts_of_descendants_with_cycles(spark, rows, tmp_path, seed):
    """p6_descendants leaves out what is on or below a cycle, as its SQL does; p6_descendants_marked tells it apart."""
    duckdb = pytest.importorskip("duckdb")
    parent = {k: v for k, v in random_links(60, seed).items() if v is not None} | {5: 5, 1: 2, 2: 3, 3: 1, 10: 2, 11: 10, 20: 20, 21: 20, 301: 5, 302: 301, 303: 302, 304: 999, 305: 304}
    some = [(o, n, p, f"n{n}") for o, (n, p) in enumerate(parent.items())] + [(900, 302, 301, "n302"), (901, 310, None, "top"), (902, 311, 310, None), (903, None, 5, "lost")]
    tables = {
        "volume_info": spark.createDataFrame([(5, 5)], "root_frn long, root_id long"),
        "raw_record": spark.createDataFrame(some, "ord long, frn long, parent_frn long, name_utf16 string"),
        "entry": spark.createDataFrame([(n, 4294967294 if p is None else p, name) for _, n, p, name in some], "id long, parent long, name string").where("id IS NOT NULL"),
    }
    db = duckdb.connect()
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {name: rows(queries_data.QUERIES[name](spark, str(tmp_path))) for name in ("p6_descendants", "p6_descendants_marked")}
    for name in got:
        assert got[name] == sorted(db.execute(queries_data.ORACLE[name]).fetchall())
    assert ("entry", 301, 2) in got["p6_descendants"] and ("entry", 2, 2, True) in got["p6_descendants_marked"]
    assert got["p6_descendants"] == [r[:3] for r in got["p6_descendants_marked"] if not r[3]]


def ends_by_hand(parent, root):
    """{node: (top, depth)} by walks that stop at nodes known already."""
    out = {}
    for start in parent:
        path, places, x = [], {}, start
        while True:
            if x in out:
                top, depth = out[x]
            elif x in places:
                top, depth = min(path[places[x] :]), -1
            elif parent[x] == root:
                top, depth = root, 0
                out[x] = top, depth
            elif parent[x] not in parent:
                top, depth = x, 0
                out[x] = top, depth
            else:
                places[x] = len(path)
                path.append(x)
                x = parent[x]
                continue
            break
        for i, y in enumerate(reversed(path), 1):
            out[y] = (top, -1 if depth == -1 else depth + i)
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize(("tab", "make", "root", "sizes"), [("raw_record", hierarchy.record_links, "root_frn", (2, 20, 400, 4000, None)), ("entry", hierarchy.entry_links, "root_id", (20, 4000, None))])
def test_forest_of_whole_tables_at_every_size_of_the_last_task(spark, tab, make, root, sizes):
    d = "/root/testdata/sf0.1"
    root = runtime.read_table(spark, d, "volume_info").first()[root]
    shape = [(10**9 + i, 10**9 + i - 1 if i else root, "") for i in range(71)] + [(2 * 10**9 + i, 2 * 10**9 + (i + 1) % 50, "") for i in range(50)] + [(3 * 10**9, 2 * 10**9 + 9, "")]
    links = make(runtime.read_table(spark, d, tab)).unionByName(spark.createDataFrame(shape, "node long, parent long, name string"))
    links = runtime.materialise(links.select("node", "parent"))
    want = ends_by_hand({r["node"]: r["parent"] for r in links.collect()}, root)
    assert want[10**9 + 70] == (root, 70) and want[3 * 10**9] == (2 * 10**9, -1)
    for merge_rows in sizes:
        got = {r["node"]: (r["top"], r["depth"]) for r in hierarchy.resolve_forest(links, F.lit(root).cast("long"), merge_rows).collect()}
        assert got == want


def test_forest_of_keys_that_no_float_holds(spark, rows):
    big = (1 << 62) + 1
    parent = {big + i: big + i - 1 for i in range(1, 9)} | {big: None}
    links = runtime.materialise(spark.createDataFrame(list(parent.items()), "node long, parent long"))
    for merge_rows in (1000, 2):
        forest = runtime.materialise(hierarchy.resolve_forest(links, F.lit(5).cast("long"), merge_rows))
        assert rows(forest) == forest_by_hand(parent, 5)
    named = links.withColumn("name", F.lit("x"))
    paths = {r["node"]: r["path"] for r in hierarchy.materialise_paths(named, forest, F.lit(5).cast("long"), "C:").collect()}
    assert paths[big + 8] == "<orphan>" + "\\x" * 9
