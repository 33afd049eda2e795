"""Registered queries p2, p4 and p6, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .operators import changes, hierarchy, references
from .runtime import read_table


def _root(spark: SparkSession, d: str, column: str) -> Column:
    row = read_table(spark, d, "volume_info").select(column).first()  # the table has one row
    return F.lit(row[0] if row else None).cast("long")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    state = changes.journal_state(read_table(spark, d, "usn_event"))
    return changes.current_rows(state).select("frn", "parent_frn", "usn")


def p2_with_base(spark: SparkSession, d: str) -> DataFrame:
    """All frns, tombstones included, after the feed is applied to the enumerated records."""
    base = changes.records_as_base(read_table(spark, d, "raw_record").where(F.col("frn").isNotNull()))
    return changes.journal_state(read_table(spark, d, "usn_event"), base).select("frn", "parent_frn", "deleted", (F.col("usn") < 0).alias("from_base"))


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    records, entries = read_table(spark, d, "raw_record"), read_table(spark, d, "entry")
    a = references.record_orphans(records, read_table(spark, d, "usn_event"), _root(spark, d, "root_frn"))
    b = references.entry_orphans(entries, _root(spark, d, "root_id"))
    return a.withColumn("tab", F.lit("raw_record")).unionByName(b.withColumn("tab", F.lit("entry")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_rows(spark, d).select("tab", "row_key", "why")


def p4_by_period(spark: SparkSession, d: str) -> DataFrame:
    return references.count_by_period(p4_rows(spark, d), "day").select("tab", F.date_format("period", "yyyy-MM-dd").alias("period"), "why", "n")


def _forests(spark: SparkSession, d: str):
    for tab, make, root in (("raw_record", hierarchy.record_links, "root_frn"), ("entry", hierarchy.entry_links, "root_id")):
        yield tab, read_table(spark, d, tab), make, _root(spark, d, root)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for tab, rows, make, root in _forests(spark, d):
        links = runtime.materialise(make(rows).select("node", "parent"))
        forest = hierarchy.resolve_forest(links, root)
        parts.append(forest.select(F.lit(tab).alias("tab"), "node", F.col("top").alias("top_node"), "depth"))
    return parts[0].unionByName(parts[1])


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for tab, rows, make, root in _forests(spark, d):
        links = runtime.materialise(make(rows))
        forest = runtime.materialise(hierarchy.resolve_forest(links.select("node", "parent"), root))
        paths = hierarchy.materialise_paths(links, forest, root, "C:")
        parts.append(paths.select(F.lit(tab).alias("tab"), "node", F.col("top").alias("top_node"), "depth", "path", (F.col("depth") < 0).alias("circular")))
    return parts[0].unionByName(parts[1])


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """How many descendants every node with children has, but for those on or below a cycle (see p6_descendants_marked)."""
    parts = []
    for tab, rows, make, root in _forests(spark, d):
        links = runtime.materialise(make(rows).select("node", "parent"))
        forest = runtime.materialise(hierarchy.resolve_forest(links, root))
        totals = hierarchy.sound_totals(links, forest, root, {"n_below": F.count(F.lit(1))})
        parts.append(totals.select(F.lit(tab).alias("tab"), "node", "n_below"))
    return parts[0].unionByName(parts[1])


def p6_descendants_marked(spark: SparkSession, d: str) -> DataFrame:
    """The same for all nodes with children, those on or below a cycle told apart; a node of a cycle counts what hangs below it."""
    parts = []
    for tab, rows, make, root in _forests(spark, d):
        links = runtime.materialise(make(rows).select("node", "parent"))
        forest = runtime.materialise(hierarchy.resolve_forest(links, root))
        totals = hierarchy.marked_totals(links, forest, root, {"n_below": F.count(F.lit(1))})
        parts.append(totals.select(F.lit(tab).alias("tab"), "node", "n_below", "circular"))
    return parts[0].unionByName(parts[1])


def p6_descendant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each of its ancestors and the distance; nodes on a cycle are tops of what hangs below them."""
    parts = []
    for tab, rows, make, root in _forests(spark, d):
        links = runtime.materialise(make(rows).select("node", "parent"))
        forest = runtime.materialise(hierarchy.resolve_forest(links, root))
        pairs = hierarchy.marked_descendants(links, forest, root)
        parts.append(pairs.select(F.lit(tab).alias("tab"), "ancestor", "node", "distance", "circular"))
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (p2_found, p2_with_base, p4_found, p4_by_period, p6_found, p6_paths, p6_descendants, p6_descendants_marked, p6_descendant_pairs)}

_STATE = """
ev AS (SELECT *, (reason & 512) <> 0 AS del FROM usn_event WHERE usn IS NOT NULL AND frn IS NOT NULL
       AND ((reason & 512) <> 0 OR ((reason & 8448) <> 0 AND NOT ((reason & 4096) <> 0 AND (reason & 8192) = 0)))),
st AS (SELECT frn, parent_frn, usn, del FROM ev
       QUALIFY row_number() OVER (PARTITION BY frn ORDER BY usn DESC, del DESC, parent_frn DESC NULLS LAST) = 1)"""

_P4 = f"""WITH {_STATE},
r AS (SELECT ord, max(parent_frn) AS parent, max(seen_at) AS tm FROM raw_record WHERE parent_frn IS NOT NULL AND parent_frn <> (SELECT root_frn FROM volume_info) GROUP BY ord),
rr AS (SELECT 'raw_record' AS tab, ord AS row_key, tm, CASE WHEN s.del THEN 'deleted' WHEN k.frn IS NOT NULL THEN NULL WHEN s.frn IS NOT NULL THEN 'late' ELSE 'missing' END AS why
       FROM r LEFT JOIN st s ON s.frn = r.parent LEFT JOIN (SELECT DISTINCT frn FROM raw_record) k ON k.frn = r.parent),
e AS (SELECT DISTINCT id, parent, flags, added_at FROM entry),
ee AS (SELECT 'entry' AS tab, c.id AS row_key, c.added_at AS tm, CASE WHEN p.id IS NULL THEN 'missing' WHEN (p.flags & 8) <> 0 THEN 'deleted' WHEN p.added_at > c.added_at THEN 'late' END AS why
       FROM e c LEFT JOIN e p ON p.id = c.parent
       WHERE (c.flags & 8) = 0 AND c.parent IS NOT NULL AND c.parent <> 4294967294 AND c.parent <> (SELECT root_id FROM volume_info)),
o AS (SELECT * FROM rr WHERE why IS NOT NULL UNION ALL SELECT * FROM ee WHERE why IS NOT NULL)
"""

_P6 = r"""WITH RECURSIVE
l AS (SELECT 'raw_record' AS tab, frn AS node, arg_max(struct_pack(p := parent_frn, n := name_utf16), ord) AS r, (SELECT root_frn FROM volume_info) AS root FROM raw_record GROUP BY frn
      UNION ALL SELECT 'entry', id, max(struct_pack(p := CASE WHEN parent <> 4294967294 THEN parent END, n := name)), (SELECT root_id FROM volume_info) FROM entry GROUP BY id),
n AS MATERIALIZED (SELECT tab, node, r.p AS parent, coalesce(r.n, '') AS name, root FROM l),
t AS (SELECT n.tab, n.node, CASE WHEN n.parent = n.root THEN n.root ELSE n.node END AS top_node, 0 AS depth,
             CASE WHEN n.parent = n.root THEN 'C:' ELSE '<orphan>' END || chr(92) || n.name AS path
      FROM n LEFT JOIN n p ON p.tab = n.tab AND p.node = n.parent WHERE n.parent IS NULL OR n.parent = n.root OR p.node IS NULL
      UNION ALL
      SELECT n.tab, n.node, t.top_node, t.depth + 1, t.path || chr(92) || n.name FROM n JOIN t ON n.tab = t.tab AND n.parent = t.node WHERE n.parent <> n.root),
c AS (SELECT n.* FROM n ANTI JOIN t ON n.tab = t.tab AND n.node = t.node),
u AS (SELECT tab, node AS start, parent AS cur FROM c UNION SELECT u.tab, u.start, c.parent FROM u JOIN c ON c.tab = u.tab AND c.node = u.cur),
ring AS (SELECT tab, start AS node FROM u WHERE start = cur),
low AS (SELECT u.tab, u.start AS node, min(u.cur) AS top_node FROM u JOIN ring r ON r.tab = u.tab AND r.node = u.cur GROUP BY u.tab, u.start),
res AS (SELECT tab, node, top_node, depth, path FROM t UNION ALL SELECT tab, node, top_node, -1, NULL FROM low)
"""

ORACLE = {
    "p2_found": f"WITH {_STATE} SELECT frn, parent_frn, usn FROM st WHERE NOT del",
    "p2_with_base": f"""WITH {_STATE},
b AS (SELECT frn, parent_frn FROM raw_record WHERE frn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frn ORDER BY ord DESC, parent_frn DESC NULLS LAST) = 1)
SELECT coalesce(s.frn, b.frn) AS frn, CASE WHEN s.frn IS NOT NULL THEN s.parent_frn ELSE b.parent_frn END AS parent_frn, coalesce(s.del, FALSE) AS deleted, s.frn IS NULL AS from_base
FROM st s FULL JOIN b ON b.frn = s.frn""",
    "p4_found": _P4 + "SELECT tab, row_key, why FROM o",
    "p4_by_period": _P4 + "SELECT tab, strftime(tm AT TIME ZONE 'UTC', '%Y-%m-%d') AS period, why, count(*) AS n FROM o GROUP BY ALL",
    "p6_found": _P6 + "SELECT tab, node, top_node, CAST(depth AS INTEGER) AS depth FROM res",
    "p6_paths": _P6 + "SELECT tab, node, top_node, CAST(depth AS INTEGER) AS depth, path, depth < 0 AS circular FROM res",
    "p6_descendants": _P6 + """, up AS (SELECT n.tab, n.node, n.parent AS above FROM n JOIN t ON t.tab = n.tab AND t.node = n.node WHERE n.parent IS NOT NULL AND n.parent <> n.root
  UNION ALL SELECT up.tab, up.node, n.parent FROM up JOIN n ON n.tab = up.tab AND n.node = up.above WHERE n.parent IS NOT NULL AND n.parent <> n.root)
SELECT up.tab, above AS node, count(*) AS n_below FROM up JOIN n k ON k.tab = up.tab AND k.node = up.above GROUP BY ALL""",
    "p6_descendant_pairs": _P6 + """, o AS (SELECT n.tab, n.node, CASE WHEN ring.node IS NULL AND n.parent <> n.root THEN n.parent END AS parent FROM n LEFT JOIN ring ON ring.tab = n.tab AND ring.node = n.node),
up AS (SELECT tab, parent AS above, node, 1 AS distance FROM o WHERE parent IS NOT NULL
  UNION ALL SELECT up.tab, o.parent, up.node, up.distance + 1 FROM up JOIN o ON o.tab = up.tab AND o.node = up.above WHERE o.parent IS NOT NULL)
SELECT up.tab, above AS ancestor, up.node, CAST(distance AS INTEGER) AS distance, low.node IS NOT NULL AS circular FROM up JOIN n k ON k.tab = up.tab AND k.node = up.above LEFT JOIN low ON low.tab = up.tab AND low.node = up.node""",
}
ORACLE["p6_descendants_marked"] = f"SELECT tab, ancestor AS node, count(*) AS n_below, circular FROM ({ORACLE['p6_descendant_pairs']}) GROUP BY ALL"
