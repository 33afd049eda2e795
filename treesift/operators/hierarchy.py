"""Parent links of unknown depth: roots, depths, cycles, paths, descendants."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .. import schema as S

#: Links that one task merges in memory (about 100 bytes each).
MERGE_ROWS = 2_000_000
#: Bytes of ancestor chains that one task makes at most.
CHAIN_BYTES = 1 << 28
#: `off` steps lead up from `node` to `ptr`, the least node on the way being `low`; open: the way goes on from there. Of a
#: closed link `ptr` is the top, and `off` is -1 on or below a cycle. No column is ever null, so that keys stay integers.
_LINKS = "node long, ptr long, off long, low long, open boolean"


def _merge_links(links: pd.DataFrame, whole: bool) -> pd.DataFrame:
    """Weighted disjoint sets of one task's links (see _LINKS) with full path compression.

    Every pass doubles the steps behind all pointers at once. `whole`: all links are here, so a pointer to an unknown node
    ends at the node itself.
    """
    links = links.sort_values("node", ignore_index=True)
    node, ptr, off, low = (links[c].to_numpy(np.int64).copy() for c in ("node", "ptr", "off", "low"))
    going = links["open"].to_numpy(bool).copy()
    ring = ~going & (off == -1)
    n = len(node)
    at = np.minimum(np.searchsorted(node, ptr), max(n - 1, 0))
    nxt = np.where(going & (node[at] == ptr), at, -1) if n else np.zeros(0, np.int64)
    if whole:
        lost = going & (nxt < 0)
        ptr[lost], off[lost], going[lost] = node[lost], 0, False
    for _ in range(n.bit_length() + 1):
        go = np.flatnonzero(nxt >= 0)
        if not len(go):
            break
        to = nxt[go]
        values = off[go] + off[to], np.minimum(low[go], low[to]), nxt[to], ptr[to], going[to], ring[to]
        off[go], low[go], nxt[go], ptr[go], going[go], ring[go] = values
    turning = nxt >= 0  # still moving after n steps: `nxt` lies on the cycle and its `low` has seen all of it
    ptr[turning], going[turning] = low[nxt[turning]], False
    off[ring | turning] = -1
    return pd.DataFrame({"node": node, "ptr": ptr, "off": off, "low": low, "open": going})


def _merger(whole: bool):
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            merged = _merge_links(pd.concat(parts, ignore_index=True), whole)
            for i in range(0, len(merged), 100_000):
                yield merged.iloc[i : i + 100_000]

    return merge


def _onward(links: DataFrame, known: DataFrame, follow: Column, where: str) -> DataFrame:
    """Open links whose pointer has a row in `known` that `follow` accepts go on by what that row says; others stay."""
    far = known.select(F.col("node").alias("__n"), *[F.col(c).alias(f"__{c}") for c in ("ptr", "off", "low", "open")])
    joined = links.join(far, F.col("open") & (F.col("ptr") == F.col("__n")), where)
    go = F.coalesce(F.col("open") & F.col("__n").isNotNull() & follow, F.lit(False))
    circular = ~F.col("__open") & (F.col("__off") == -1)
    return joined.select(
        "node", F.when(go, F.col("__ptr")).otherwise(F.col("ptr")).alias("ptr"), F.when(go & circular, F.lit(-1)).when(go, F.col("off") + F.col("__off")).otherwise(F.col("off")).cast("long").alias("off"),
        F.when(go, F.least("low", "__low")).otherwise(F.col("low")).alias("low"), F.when(go, F.col("__open")).otherwise(F.col("open")).alias("open"),
    )


def _inner_forest(inner: DataFrame, merge_rows: int) -> DataFrame:
    """(node, top, off) of the links (node, parent, open) of nodes that are parents.

    While more links are left than the last task may hold, a level shrinks them: tasks hold ranges of nodes and compress
    the chains inside; a join then closes links that lead to closed ones, and cuts out about a quarter of the nodes of every
    chain (those that a coin by hash says, where it spares the next); only nodes that others still point to go on to the
    next level. The last level is one task. Then the levels are gone through backwards: a link of a level that was left open
    ends where the node it points to, known from the level above, ends. Levels shrink geometrically, whatever the shape, so
    all of them together cost a few times the first.
    """
    spark = inner.sparkSession
    runtime.ship_package(spark)
    n = inner.count()
    if n > merge_rows:
        there = inner.select(F.col("node").alias("__k"))
        joined = inner.join(there, F.col("open") & (F.col("ptr") == F.col("__k")), "left")
        lost = F.col("open") & F.col("__k").isNull()
        inner = joined.select("node", F.when(lost, F.col("node")).otherwise(F.col("ptr")).alias("ptr"), (F.col("open") & ~lost).alias("open"))
    links = inner.select("node", "ptr", F.col("open").cast("long").alias("off"), F.col("node").alias("low"), "open")
    levels: list[DataFrame] = []
    while n > merge_rows:
        tasks = max(min(math.ceil(n / merge_rows), runtime.slots(spark)), math.ceil(n / MERGE_ROWS))
        local = runtime.materialise(links.repartitionByRange(tasks, "node").mapInPandas(_merger(False), _LINKS))
        heads = lambda c: F.xxhash64(c, F.lit(len(levels))).bitwiseAND(F.lit(1)) == 1  # noqa: B023, E731
        cut = ~F.col("__open") | (~heads("__n") & heads("__ptr"))
        levels.append(runtime.materialise(_onward(local, local, cut, "left")))
        wanted = levels[-1].where("open").select(F.col("ptr").alias("node")).distinct()
        links = runtime.materialise(levels[-1].join(wanted, "node", "left_semi"))
        n = links.count()
    done = links.coalesce(1).mapInPandas(_merger(True), _LINKS)
    for level in reversed(levels):
        done = runtime.materialise(_onward(level, done, F.lit(True), "left"))
    end = F.when(F.col("open"), F.raise_error(F.lit("a link without a top"))).otherwise(F.col("ptr"))
    return done.select("node", end.cast("long").alias("top"), "off")


def parent_links(links: DataFrame, root: Column) -> DataFrame:
    """(node, ptr, open) of the nodes that have children: ptr is the parent, or where the way up ends at once."""
    up = F.col("parent").isNotNull() & (F.col("parent") != root)
    parents = links.where(up).select(F.col("parent").alias("node")).distinct()
    inner = links.join(parents, "node", "left_semi")
    return inner.select("node", F.coalesce("parent", "node").alias("ptr"), F.coalesce(up, F.lit(False)).alias("open"))


def resolve_forest(links: DataFrame, root: Column, merge_rows: int | None = None) -> DataFrame:
    """(node, parent, top, depth) of every node of `links` (node long unique, parent long).

    Going up ends at the root (top = root), at a node with a null or absent parent (top = that node), or in a cycle
    (top = its least node, depth -1 for all nodes on or below it). depth is 0 right under the root and at such a top.

    Only nodes that are parents take part in the merging of links (weighted disjoint sets, see _inner_forest); all others
    hang on them by one join. A parent with a third of all children is one row among the parents, and adaptive skew
    handling splits its children in that join. `links` is read three times: pass a materialised table.
    """
    forest = _inner_forest(runtime.materialise(parent_links(links, root)), MERGE_ROWS if merge_rows is None else merge_rows)
    found = forest.select(F.col("node").alias("__n"), F.col("top").alias("__top"), F.col("off").alias("__off"))
    joined = links.join(found, F.col("parent") == F.col("__n"), "left")
    at_root = F.coalesce(F.col("parent") == root, F.lit(False))
    top = F.when(at_root, F.col("parent")).otherwise(F.when(F.col("__n").isNull(), F.col("node")).otherwise(F.col("__top")))
    depth = F.when(at_root | F.col("__n").isNull(), F.lit(0)).when(F.col("__off") == -1, F.lit(-1)).otherwise(F.col("__off") + 1)
    return joined.select("node", "parent", top.alias("top"), depth.cast("int").alias("depth"))


def _walk(batches: Iterator[pd.DataFrame], join) -> Iterator[pd.DataFrame]:
    """Chains of one task's nodes: every node takes its parent's through an index, parents first."""
    parts = [p for p in batches if len(p)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values("depth", ignore_index=True)
    made: dict = {}
    for node, ptr, chain in zip(rows["node"], rows["ptr"], rows["chain"], strict=True):
        above = made.get(ptr) if ptr != node else None
        made[node] = chain if above is None else join(above, chain)
    for i in range(0, len(rows), 10_000):
        some = rows["node"].iloc[i : i + 10_000]
        yield pd.DataFrame({"node": some, "chain": [made[n] for n in some]})


def _ancestor_chains(sound: DataFrame, root: Column, value: Column, width: Column, join, join_python) -> DataFrame:
    """(node, chain) for every parent node of `sound` (node, parent, depth, ...; no cycles): `value` of the node and all its
    ancestors, joined from the top down. `width` is about the bytes of a value.

    Where all chains together are sure to fit one task (CHAIN_BYTES, counted first), it walks them by an index. Otherwise
    by doubling: pass k knows 2^k ancestors of every node, each looked up by a join.
    """
    up = F.col("parent").isNotNull() & (F.col("parent") != root)
    parents = sound.where(up).select(F.col("parent").alias("node")).distinct()
    inner = sound.join(parents, "node", "left_semi").select("node", F.when(up, F.col("parent")).alias("ptr"), value.alias("chain"), "depth", width.alias("width"))
    inner = runtime.materialise(inner)
    n, steps, widest = inner.agg(F.count(F.lit(1)), F.sum(F.col("depth") + 1), F.max("width")).first()
    state = inner.select("node", "ptr", "chain")
    if n <= MERGE_ROWS and (steps or 0) * (widest or 0) <= CHAIN_BYTES:
        runtime.ship_package(sound.sparkSession)
        kind = dict(state.dtypes)["chain"]
        return inner.select("node", F.coalesce("ptr", "node").alias("ptr"), "chain", "depth").coalesce(1).mapInPandas(lambda batches: _walk(batches, join_python), f"node long, chain {kind}")
    for _ in range(n.bit_length() + 1):
        if not state.where(F.col("ptr").isNotNull()).limit(1).count():
            break
        far = state.select(F.col("node").alias("__n"), F.col("ptr").alias("__ptr"), F.col("chain").alias("__chain"))
        done = state.where(F.col("ptr").isNull())
        moved = state.where(F.col("ptr").isNotNull()).join(far, F.col("ptr") == F.col("__n"), "left")
        chain = F.when(F.col("__n").isNull(), F.col("chain")).otherwise(join(F.col("__chain"), F.col("chain")))
        state = runtime.materialise(done.unionByName(moved.select("node", F.col("__ptr").alias("ptr"), chain.alias("chain"))))
    return state.where(F.col("ptr").isNull()).select("node", "chain")


def _acyclic(links: DataFrame, forest: DataFrame) -> DataFrame:
    return links.join(forest.where(F.col("depth") >= 0).select("node", "depth"), "node")


def materialise_paths(links: DataFrame, forest: DataFrame, root: Column, prefix: str, orphan_prefix: str = "<orphan>") -> DataFrame:
    r"""(node, parent, top, depth, path) for the nodes of `links` (node, parent, name) resolved in `forest`.

    Under the root a path is prefix, under another top orphan_prefix; nodes on or below a cycle have a null path. A
    null name counts as empty. Paths of parents are made first; every node then takes its parent's by one join.
    """
    named = links.select("node", "parent", F.coalesce("name", F.lit("")).alias("name"))
    sound = runtime.materialise(_acyclic(named, forest))
    chains = _ancestor_chains(sound, root, F.col("name"), F.octet_length("name") + 1, lambda a, b: F.concat(a, F.lit("\\"), b), lambda a, b: f"{a}\\{b}")
    of_parent = chains.select(F.col("node").alias("__n"), F.col("chain").alias("__chain"))
    tails = sound.join(of_parent, F.col("parent") == F.col("__n"), "left").select("node", F.concat_ws("\\", "__chain", "name").alias("tail"))
    start = F.when(F.col("top") == root, F.lit(prefix)).otherwise(F.lit(orphan_prefix))
    return forest.join(tails, "node", "left").select("node", "parent", "top", "depth", F.when(F.col("tail").isNotNull(), F.concat(start, F.lit("\\"), "tail")).alias("path"))


def _rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes on cycles among one task's links, all of which lead to or along a cycle."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values("node", ignore_index=True)
    node = rows["node"].to_numpy(np.int64)
    at = np.searchsorted(node, rows["parent"].to_numpy(np.int64))
    for _ in range(len(node).bit_length()):  # after more steps than there are nodes all stand on cycles, and every place is held
        at = at[at]
    yield pd.DataFrame({"node": node[np.unique(at)]})


def ring_nodes(forest: DataFrame, merge_rows: int | None = None) -> DataFrame:
    """(node): the nodes of `forest` that lie on a cycle themselves, not below one."""
    merge_rows = MERGE_ROWS if merge_rows is None else merge_rows
    circular = forest.where(F.col("depth") == -1).select("node", "parent")
    inner = runtime.materialise(circular.join(circular.select(F.col("parent").alias("node")).distinct(), "node", "left_semi"))
    n = inner.count()
    if n <= merge_rows:
        runtime.ship_package(forest.sparkSession)
        return runtime.materialise(inner.coalesce(1).mapInPandas(_rings, "node long"))
    for _ in range(n.bit_length()):
        far = inner.select(F.col("node").alias("parent"), F.col("parent").alias("__far"))
        inner = runtime.materialise(inner.join(far, "parent").select("node", F.col("__far").alias("parent")))
    return inner.select(F.col("parent").alias("node")).distinct()


def open_rings(links: DataFrame, forest: DataFrame, root: Column) -> tuple[DataFrame, DataFrame]:
    """`links` with a null parent for the nodes on a cycle, and (node, depth, circular) of all nodes of these open links.

    The links along a cycle have no end and count for nothing here; what hangs below a node of a cycle is a finite tree
    with that node as its top, and `circular` says so of all its nodes.
    """
    rings = ring_nodes(forest).select(F.col("node").alias("__ring"))
    opened = links.join(rings, F.col("node") == F.col("__ring"), "left").withColumn("parent", F.when(F.col("__ring").isNull(), F.col("parent"))).drop("__ring")
    circular = forest.where(F.col("depth") == -1).join(rings, F.col("node") == F.col("__ring"), "left")
    below = runtime.materialise(circular.select("node", F.when(F.col("__ring").isNull(), F.col("parent")).alias("parent")))
    sound = forest.where(F.col("depth") >= 0).select("node", "depth", F.lit(False).alias("circular"))
    return opened, sound.unionByName(resolve_forest(below, root).select("node", "depth", F.lit(True).alias("circular")))


def ancestor_arrays(links: DataFrame, forest: DataFrame, root: Column) -> DataFrame:
    """(node, ancestors array<long>, nearest last, the node itself included) of every parent node of depth 0 or more; given
    the two results of open_rings, of every parent node, those under a cycle from the node of the cycle on."""
    sound = runtime.materialise(_acyclic(links.select("node", "parent"), forest))
    return _ancestor_chains(sound, root, F.array("node"), F.lit(8), F.concat, lambda a, b: [*a, *b])


def descendants(links: DataFrame, forest: DataFrame, root: Column) -> DataFrame:
    """(ancestor, node, distance): every node with each of its proper ancestors, the root apart. A node of a cycle is the
    top of what hangs below it; the nodes of a cycle are no ancestors of each other."""
    return _descendants(*open_rings(links, forest, root), root)


def _descendants(opened: DataFrame, depths: DataFrame, root: Column) -> DataFrame:
    chains = ancestor_arrays(opened, depths, root).select(F.col("node").alias("__n"), "chain")
    rows = opened.join(chains, F.col("parent") == F.col("__n")).select("node", F.size("chain").alias("n"), F.posexplode("chain").alias("i", "ancestor"))
    return rows.select("ancestor", "node", (F.col("n") - F.col("i")).alias("distance"))


def marked_descendants(links: DataFrame, forest: DataFrame, root: Column) -> DataFrame:
    """(ancestor, node, distance, circular): descendants, those on or below a cycle told apart."""
    opened, depths = open_rings(links, forest, root)
    return _descendants(opened, depths, root).join(depths.select("node", "circular"), "node").select("ancestor", "node", "distance", "circular")


def subtree_totals(links: DataFrame, forest: DataFrame, root: Column, measures: dict[str, Column]) -> DataFrame:
    """(node, measures...) for every node with children: each measure (a sum over child rows) over the whole subtree. For
    nodes of a cycle, that is what hangs below them; children along the cycle don't count."""
    return _totals(*open_rings(links, forest, root), root, measures)


def sound_totals(links: DataFrame, forest: DataFrame, root: Column, measures: dict[str, Column]) -> DataFrame:
    """subtree_totals of the nodes that are neither on nor below a cycle, alone."""
    return _totals(links, forest, root, measures)


def marked_totals(links: DataFrame, forest: DataFrame, root: Column, measures: dict[str, Column]) -> DataFrame:
    """(node, measures..., circular): subtree_totals, the nodes on or below a cycle told apart."""
    opened, depths = open_rings(links, forest, root)
    return _totals(opened, depths, root, measures).join(depths.select("node", "circular"), "node")


def _totals(links: DataFrame, depths: DataFrame, root: Column, measures: dict[str, Column]) -> DataFrame:
    """The measures over the subtrees of the nodes that have a depth of 0 or more in `depths`.

    Children are first summed under their parent, combined before the shuffle, so leaves never meet the list of their
    ancestors: only one row per parent is spread over its ancestors.
    """
    direct = links.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(*[m.alias(k) for k, m in measures.items()])
    spread = ancestor_arrays(links, depths, root).join(direct, "node").select(F.explode("chain").alias("node"), *measures)
    return spread.groupBy("node").agg(*[F.sum(k).alias(k) for k in measures])


def record_links(records: DataFrame) -> DataFrame:
    """(node, parent, name): one row per frn, taken from its record of greatest ord (of equal ones the greatest parent)."""
    rows = records.where(F.col("frn").isNotNull())
    last = rows.groupBy(F.col("frn").alias("node")).agg(F.max(F.struct(F.col("ord"), F.col("parent_frn").alias("parent"), F.col("name_utf16").alias("name"))).alias("r"))
    return last.select("node", "r.parent", "r.name")


def entry_links(entries: DataFrame) -> DataFrame:
    """(node, parent, name): one row per id, dead rows included; the sentinel parent is null (of unequal rows the greatest)."""
    rows = entries.where(F.col("id").isNotNull())
    parent = F.when(F.col("parent") != S.NO_PARENT, F.col("parent"))
    one = rows.groupBy(F.col("id").alias("node")).agg(F.max(F.struct(parent.alias("parent"), F.col("name"))).alias("r"))
    return one.select("node", "r.parent", "r.name")
