"""Registered queries of this subpackage beside their SQL on the smallest tables; skipped where those are not there."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
from tools.compare import canon  # noqa: E402

from treesift.llm import queries  # noqa: E402

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.QUERIES[name](spark, D).toPandas()
    assert len(got.columns)
    if name in queries.ORACLE:
        db = duckdb.connect(config={"memory_limit": "4GB"})
        db.execute("SET TimeZone='UTC'")
        for f in os.listdir(D):
            db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
        want = db.execute(queries.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_every_pair_has_one_canonical_member(spark):
    pairs, members = queries.p5_found(spark, D).toPandas(), queries.p5_canonical(spark, D).toPandas()
    best = {(r.tab, r.key): (r.scope, r.canonical) for r in members.itertuples()}
    assert all(best[r.tab, r.key_a] == best[r.tab, r.key_b] and best[r.tab, r.key_a] is not None for r in pairs.itertuples())
    assert {(r.tab, k) for r in pairs.itertuples() for k in (r.key_a, r.key_b)} == set(best)
