"""Requests, phases, kept answers and the watch loop."""

import pytest

from treesift import schema as S
from treesift.operators import volume as V
from treesift.plans.front import SearchRequest, UsageRequest
from treesift.service import Building, RecentAnswers, Service
from treesift.sources import snapshot
from treesift.sources.volumes import MemoryVolume
from treesift.streaming.journal import Watched

D = S.A_DIRECTORY
ROWS = [(0, 5, 5, "", D), (1, 10, 5, "docs", D), (2, 11, 10, "report.txt", 0), (3, 12, 10, "my report", 0)]


def test_requests(spark):
    building = Service(spark)
    assert building.search(SearchRequest("a")).phase == "building" and building.status().first()["phase"] == "building"
    with pytest.raises(Building):
        building.usage(UsageRequest("C:\\"))
    m = MemoryVolume(spark, ROWS, [(11, 3, False)])
    ready = Service(spark, V.build_entries(m.records(), m.sizes(), "C", 4096), cursor=2, next_usn=9)
    got = ready.search(SearchRequest("report count:1"))
    assert got.total == 2 and [r["path"] for r in got.hits.collect()] == ["C:\\docs\\report.txt"]
    rows, total = ready.usage(UsageRequest("c:/docs"))
    assert total.first()["clusters"] == 3 and rows.count() == 2 and ready.status().first()["lag"] == 7
    for path in ("D:\\docs", "C:\\none"):
        with pytest.raises(LookupError):
            ready.usage(UsageRequest(path))


def test_recent_answers():
    now, made = [0.0], []
    kept = RecentAnswers(most=2, seconds=15, clock=lambda: now[0])
    ask = lambda k: kept.get((k, ""), lambda: made.append(k) or k)
    for k in ("a", "a", "b", "a", "c", "a", "b"):
        assert ask(k) == k
    assert made == ["a", "b", "c", "b"]
    now[0] = 16
    ask("b")
    assert made[-1] == "b" and len(made) == 5


def test_watch_loop(spark, tmp_path):
    m = MemoryVolume(spark, list(ROWS), [], [])
    w = Watched.build(m)
    m.events = [(1, 13, 10, 0x100, "new.txt", 0)]
    assert w.run(2, str(tmp_path / "s"), seconds=0) == ["synced", "synced"]
    assert snapshot.load(spark, str(tmp_path / "s")).next_usn == 2
    m.journal_id = 7
    assert w.run(1, seconds=0) == ["another journal"] and w.journal_id == 7
