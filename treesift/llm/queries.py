"""Registered queries p1, p3, p5, p7, p8 and p9, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, read_table
from . import leaks, lookalike, mixture, pages, runs, topn


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(read_table(spark, d, "usn_event"), "frn", "usn", runs.canonical_reason(F.col("reason")), "ts")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where(F.col("n") > 1).select(F.col("entity").alias("frn"), F.col("first_seq").alias("first_usn"), F.col("last_seq").alias("last_usn"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """The collapsed feed: every run, of one event or more, with count and duration in microseconds."""
    micros = (F.unix_micros("last_at") - F.unix_micros("first_at")).alias("micros")
    return _runs(spark, d).select(F.col("entity").alias("frn"), F.col("value").alias("reason"), F.col("first_seq").alias("first_usn"), F.col("last_seq").alias("last_usn"), "n", micros)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a = topn.largest_rows(read_table(spark, d, "du_row").select("row_id", "report_id", "id", "name", "depth", "clusters"), ["report_id", "id"], ["report_id", "depth"], "clusters", "name", "row_id", 5)
    b = topn.largest_rows(read_table(spark, d, "du_row_wire").select("row_id", "report_id", "path", "size_bytes"), ["report_id", "path", "size_bytes"], ["report_id"], "size_bytes", "path", "row_id", 5)
    return a.select(F.lit("du_row").alias("tab"), "row_id").unionByName(b.select(F.lit("du_row_wire").alias("tab"), "row_id"))


def _members(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "raw_record": lookalike.lookalike_members(read_table(spark, d, "raw_record"), "ord", "parent_frn", "name_utf16"),
        "search_hit": lookalike.lookalike_members(read_table(spark, d, "search_hit"), "hit_id", "search_id", "path"),
    }


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (lookalike.lookalike_pairs(m).select(F.lit(tab).alias("tab"), "key_a", "key_b") for tab, m in _members(spark, d).items())
    return a.unionByName(b)


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every colliding row with the canonical member of its class."""
    a, b = (m.select(F.lit(tab).alias("tab"), "scope", "key", "text", "canonical") for tab, m in _members(spark, d).items())
    return a.unionByName(b)


def _search(spark: SparkSession, d: str) -> tuple[leaks.LeakSearch, DataFrame]:
    return leaks.LeakSearch(read_table(spark, d, "eval_item"), "item_id", "text"), read_table(spark, d, "documents")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    search, docs = _search(spark, d)
    return search.verbatim(docs, "doc_id", "text")


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    search, docs = _search(spark, d)
    return search.reparameterised(docs, "doc_id", "text")


def p8_draw(spark: SparkSession, d: str) -> DataFrame:
    return mixture.draw_mixture(read_table(spark, d, "documents"), read_table(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read_table(spark, d, "mix_target")
    draw, aimed = mixture.draw_mixture(read_table(spark, d, "documents"), targets)
    return mixture.mixture_shares(materialise(draw), targets, aimed * mixture.BLOCK_TOKENS)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target: whether no document is drawn more than max_repeats times, and whether the tokens drawn are the target's
    share or, out of reach, all that the cap allows (to a block a pass)."""
    targets = read_table(spark, d, "mix_target")
    docs = read_table(spark, d, "documents")
    draw, aimed = mixture.draw_mixture(docs, targets)
    held = mixture.count_tokens(docs.where(F.col("source").isNotNull()).select("source", "text"), "text").groupBy("source").agg(F.sum("n_tokens").alias("held"))
    rows = mixture.mixture_shares(materialise(draw), targets, aimed * mixture.BLOCK_TOKENS).join(held, "source", "left")
    want = F.least(F.col("target_share") * aimed * mixture.BLOCK_TOKENS, F.coalesce("held", F.lit(0)) * F.col("max_repeats"))
    near = F.abs(F.col("tokens") - want) <= mixture.BLOCK_TOKENS * (1 + F.col("max_repeats"))
    return rows.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"), near.alias("share_met"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.advertising_pages(read_table(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id")


def p9_measures(spark: SparkSession, d: str) -> DataFrame:
    return pages.advertising_pages(read_table(spark, d, "documents"), "doc_id", "text", "lang")


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p3_found, p5_found, p5_canonical, p7_found, p7_reparameterised, p8_draw, p8_shares, p8_checks, p9_found, p9_measures)}

_RUNS = """WITH e AS (SELECT frn, usn, min(reason & ~2147483648) AS r, min(ts) AS ts FROM usn_event WHERE frn IS NOT NULL AND usn IS NOT NULL GROUP BY frn, usn),
c AS (SELECT frn, usn, ts, CASE WHEN (r & 7) <> 0 THEN (r & ~7) | 1 ELSE r END AS reason FROM e),
s AS (SELECT *, CASE WHEN reason IS NOT DISTINCT FROM lag(reason) OVER w AND lag(usn) OVER w IS NOT NULL THEN 0 ELSE 1 END AS starts FROM c WINDOW w AS (PARTITION BY frn ORDER BY usn)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY frn ORDER BY usn) AS run FROM s),
x AS (SELECT frn, any_value(reason) AS reason, min(usn) AS first_usn, max(usn) AS last_usn, count(*) AS n, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS micros FROM g GROUP BY frn, run)
"""

ORACLE = {
    "p1_found": _RUNS + "SELECT frn, first_usn, last_usn FROM x WHERE n > 1",
    "p1_runs": _RUNS + "SELECT * FROM x",
    "p3_found": """WITH a AS (SELECT * FROM du_row WHERE clusters IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id, id ORDER BY row_id) = 1),
b AS (SELECT * FROM du_row_wire WHERE size_bytes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id, path, size_bytes ORDER BY row_id) = 1)
SELECT 'du_row' AS tab, row_id FROM a QUALIFY row_number() OVER (PARTITION BY report_id, depth ORDER BY clusters DESC, name, row_id) <= 5
UNION ALL SELECT 'du_row_wire', row_id FROM b QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY size_bytes DESC, path, row_id) <= 5""",
    "p7_found": r"""WITH i AS (SELECT item_id, w, least(12, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
dw AS (SELECT DISTINCT doc_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, k)""",
    "p8_checks": "SELECT source, TRUE AS cap_kept, TRUE AS share_met FROM mix_target",
    "p7_reparameterised": r"""WITH it AS (SELECT DISTINCT item_id, text FROM eval_item WHERE item_id IS NOT NULL AND text IS NOT NULL),
nm AS (SELECT DISTINCT lower(regexp_extract(b, '^\p{Lu}\p{Ll}+')) AS w FROM (SELECT unnest(list_zip(t, t[2:])) AS z FROM (SELECT string_split(text, ' ') AS t FROM it)) x(z), LATERAL (SELECT z[1] AS a, z[2] AS b) WHERE regexp_matches(a, '[\p{Ll},]$') AND regexp_matches(b, '^\p{Lu}\p{Ll}+')),
ii AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM it),
ww AS (SELECT DISTINCT unnest(w) AS w FROM ii),
cm AS (SELECT list(w) AS common FROM ww ANTI JOIN nm USING (w)),
nl AS (SELECT list(w) AS names FROM nm),
di AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ik AS (SELECT item_id, w, list_transform(w, lambda x: KIND) AS k, least(12, len(w)) AS n FROM ii WHERE len(w) > 0),
i0 AS (SELECT item_id, n, w[s:s + n - 1] AS w, k[s:s + n - 1] AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM ik)),
i1 AS (SELECT item_id, n, w, k, list_transform(range(1, n + 1), lambda j: w[j] = k[j] AND list_contains(names, w[j])) AS m FROM i0, nl),
i2 AS (SELECT item_id, n, w, k, CASE WHEN list_bool_and(list_transform(range(1, n + 1), lambda j: m[j] OR w[j] <> k[j])) THEN list_transform(m, lambda x: FALSE) ELSE m END AS m FROM i1),
i3 AS (SELECT DISTINCT item_id, n, m, list_transform(range(1, n + 1), lambda j: CASE WHEN m[j] THEN '<name>' ELSE k[j] END) AS t, list_transform(range(1, n + 1), lambda j: CASE WHEN m[j] OR w[j] <> k[j] THEN w[j] ELSE '' END) AS f FROM i2),
dk AS (SELECT doc_id, w, list_transform(w, lambda x: KIND) AS k FROM di),
d1 AS (SELECT DISTINCT doc_id, n, w[s:s + n - 1] AS w, k[s:s + n - 1] AS k FROM (SELECT doc_id, w, k, n, unnest(range(1, len(w) - n + 2)) AS s FROM dk, (SELECT DISTINCT n FROM i3) WHERE len(w) >= n)),
d2 AS (SELECT DISTINCT doc_id, n, m, list_transform(range(1, n + 1), lambda j: CASE WHEN m[j] AND w[j] = k[j] THEN '<name>' ELSE k[j] END) AS t, list_transform(range(1, n + 1), lambda j: CASE WHEN m[j] OR w[j] <> k[j] THEN w[j] ELSE '' END) AS f
  FROM d1 JOIN (SELECT DISTINCT n, m FROM i3) USING (n)),
b AS (SELECT DISTINCT doc_id, item_id, n, m, t, d2.f AS f FROM d2 JOIN i3 USING (n, m, t), cm WHERE d2.f <> i3.f AND list_unique(list_zip(d2.f, i3.f)) = list_unique(d2.f) AND list_unique(list_zip(d2.f, i3.f)) = list_unique(i3.f)
  AND NOT list_has_any(common, list_filter(d2.f, lambda x, j: m[j])))
SELECT doc_id, item_id, count(*) AS n_windows FROM b GROUP BY ALL""".replace("KIND", f"CASE WHEN regexp_full_match(x, '\\p{{N}}+') THEN '<number>' WHEN x IN {tuple(leaks.UNITS)} THEN '<unit>' ELSE x END"),
}
