"""Mix sources to target weights: blocks of tokens, drawn per source, small sources repeated a capped number of times."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import runtime

#: Vocabulary of a public byte-level BPE tokenizer; the driver hands the file to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block.
BLOCK_TOKENS = 256
#: Shards whose counts are summed together before prefix sums over all shards.
SHARD_GROUP = 4096
#: Buckets that the documents of a source fall into for numbering.
BUCKETS = 1024


@lru_cache(4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`df` with `text` replaced by n_tokens; a null text has 0. Strings of special tokens are ordinary text."""
    runtime.ship_package(df.sparkSession)
    df.sparkSession.sparkContext.addFile(vocabulary)
    kept, name = [c for c in df.columns if c != text], vocabulary.rsplit("/", 1)[-1]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(SparkFiles.get(name))
        for batch in batches:
            sizes = [0 if t is None else len(encoder.encode_ordinary(t)) for t in batch[text]]
            yield batch[kept].assign(n_tokens=np.array(sizes, np.int64))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text) + ", n_tokens long"
    return df.mapInPandas(count, schema)


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (two multiply-and-shift rounds)."""
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Pseudorandom permutations of 0..size-1, one for each (size, key): a Feistel network over the next even power of two
    above `size`, walked on until it falls below `size`. Element-wise and stateless, so any task can compute any slot."""
    n = size.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    key = key.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right, k + np.uint64(r * 0x1000193)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(index.to_numpy(np.int64), size.to_numpy(np.int64), key.to_numpy(np.int64).view(np.uint64)))


def pack_tokens(docs: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, n_tokens, start): where each document lies in the stream of tokens of its source.

    Documents of a source follow each other in the order of a hash. Positions are prefix sums over (source, bucket), with
    the buckets' sums added, so no task numbers a whole source.
    """
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = docs.where(F.col("n_tokens") > 0).withColumn("h", order).withColumn("bucket", F.shiftrightunsigned("h", 54).cast("int"))
    w = W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    sums = docs.where(F.col("n_tokens") > 0).groupBy("source", F.shiftrightunsigned(order, 54).cast("int").alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("outer"))
    return rows.join(sums, ["source", "bucket"]).select("source", "doc_id", "n_tokens", (F.col("inner") + F.col("outer")).alias("start"))


def source_quotas(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: int | None, block: int) -> tuple[list[tuple[str, int, int]], int]:
    """[(source, blocks to draw, blocks there)] and the blocks aimed at: a source's quota is its share of the total, cut to its
    blocks times its repeats."""
    blocks = {s: -(-tokens.get(s, 0) // block) for s, _, _ in targets}
    wanted = total if total is not None else sum(tokens.get(s, 0) for s, share, _ in targets if share > 0)
    aimed = -(-wanted // block)
    return [(s, min(round(max(share, 0.0) * aimed), blocks[s] * max(repeats, 0)), blocks[s]) for s, share, repeats in targets], aimed


def shard_counts(quotas: np.ndarray, shards: np.ndarray, of: int, seed: int) -> np.ndarray:
    """Multinomial counts of blocks per source (columns) of each of `shards` (rows), out of `of` shards of about equal size.
    A shard's counts depend on the seed and its number only, so any task can draw any shard, at any size."""
    total = int(quotas.sum())
    sizes = [total * (int(k) + 1) // of - total * int(k) // of for k in shards]
    return np.array([np.random.default_rng([seed, int(k)]).multinomial(n, quotas / total) for k, n in zip(shards, sizes, strict=True)]).reshape(len(shards), len(quotas))


def plan_draw(spark: SparkSession, quotas: list[tuple[str, int, int]], shard_blocks: int, seed: int) -> DataFrame:
    """(shard, source, first, n, blocks): the slots that each shard takes from each source, `first` of them being gone before.

    Every task draws the multinomial counts of its shards. What all shards draw of a source is a random number near its
    quota; running sums over the shards, in groups first, are therefore scaled to end at the quota, so that shares are met
    and caps hold.
    """
    live = [q for q in quotas if q[1] > 0]
    schema = "shard long, source string, first long, n long, blocks long"
    if not live:
        return spark.createDataFrame([], schema)
    wanted = np.array([q for _, q, _ in live], np.int64)
    of = max(1, -(-int(wanted.sum()) // shard_blocks))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                shards = batch["id"].to_numpy()[at : at + 1000]
                counts = shard_counts(wanted, shards, of, seed)
                row, source = np.nonzero(counts)
                yield pd.DataFrame({"shard": shards[row], "i": source, "n": counts[row, source]})

    counts = runtime.materialise(spark.range(of).mapInPandas(draw, "shard long, i long, n long").withColumn("part", F.floor(F.col("shard") / SHARD_GROUP)))
    sums = counts.groupBy("i", "part").agg(F.sum("n").alias("n"))
    before = W.partitionBy("i").orderBy("part")
    sums = sums.select("i", "part", (F.sum("n").over(before) - F.col("n")).alias("outer"), F.sum("n").over(W.partitionBy("i")).alias("all"))
    rows = counts.withColumn("upto", F.sum("n").over(W.partitionBy("i", "part").orderBy("shard"))).join(sums, ["i", "part"])
    names = spark.createDataFrame([(k, *q) for k, q in enumerate(live)], "i long, source string, quota long, blocks long")  # a row for each target
    scaled = lambda c: F.expr(f"CAST(CAST({c} AS DECIMAL(38, 0)) * quota DIV `all` AS BIGINT)")
    rows = rows.join(F.broadcast(names), "i").withColumn("past", F.col("outer") + F.col("upto")).withColumn("prior", F.col("past") - F.col("n"))
    rows = rows.select("shard", "source", scaled("prior").alias("first"), (scaled("past") - scaled("prior")).alias("n"), "blocks")
    return rows.where(F.col("n") > 0)


def draw_mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = 1024, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, int]:
    """(draw, blocks aimed at). `docs` has doc_id, text, source; `targets` source, target_share, max_repeats.

    The draw has a row for every piece of a document in every drawn block: (shard, slot, source, pass, block, doc_id,
    first_token, n_tokens), pieces of one slot following each other by position. The token streams of the sources are packed
    into blocks of equal length; slot j of a source takes the block that the permutation of pass j div blocks sends
    j mod blocks to, so every block comes once in each pass and no token more than max_repeats times; slots and blocks meet
    in a join on (source, block). `total_tokens` defaults to all tokens of the sources that have a share.

    A source out of reach (too few tokens, or none) gives what its cap allows, and the draw is that much smaller. Rows with
    null source or id and sources without a target take no part; repeated ids count as documents of their own; a null
    share counts as 0, null repeats as 1. Targets are a list of settings: more than 100,000 raise an error.
    """
    spark = docs.sparkSession
    listed = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    wanted = sorted((r["source"], float(r["share"]), int(r["repeats"])) for r in listed.limit(100_001).collect())
    if len(wanted) > 100_000:
        raise ValueError("more than 100,000 sources")
    names = listed.select("source")
    rows = docs.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "source", "text").join(F.broadcast(names), "source", "left_semi")
    counted = runtime.materialise(count_tokens(rows, "text", vocabulary))
    packed = pack_tokens(counted, seed)
    tokens = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each target
    quotas, aimed = source_quotas(wanted, tokens, total_tokens, block_tokens)
    plan = plan_draw(spark, quotas, shard_blocks, seed)
    offset = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    size = F.sum("n").over(W.partitionBy("shard"))
    # Rows of the plan move, slots don't: a row has about a shard's blocks at most.
    sized = plan.withColumn("offset", offset).withColumn("size", size).repartition("shard", "source")
    permuted = F.pandas_udf(_permuted, "long")
    slots = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    slots = slots.withColumn("j", F.col("first") + F.col("i")).withColumn("pass", F.floor(F.col("j") / F.col("blocks")).cast("long"))
    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.xxhash64("source", "pass", F.lit(seed)))
    slot = permuted(F.col("offset") + F.col("i"), F.col("size"), F.xxhash64("shard", F.lit(seed)))
    slots = slots.select("shard", slot.alias("slot"), "source", "pass", block.alias("block"))
    end = F.col("start") + F.col("n_tokens")
    pieces = packed.select("*", F.explode(F.sequence(F.floor(F.col("start") / block_tokens).cast("long"), F.floor((end - 1) / block_tokens).cast("long"))).alias("block"))
    low, high = F.greatest("start", F.col("block") * block_tokens), F.least(end, (F.col("block") + 1) * block_tokens)
    pieces = pieces.select("source", "block", "doc_id", (low - F.col("start")).alias("first_token"), (high - low).alias("n_tokens"))
    return slots.join(pieces, ["source", "block"]).select("shard", "slot", "source", "pass", "block", "doc_id", "first_token", "n_tokens"), aimed


def mixture_shares(draw: DataFrame, targets: DataFrame, aimed_tokens: int) -> DataFrame:
    """Per target: the share wanted, tokens drawn, shares of the draw and of the size aimed at, and how often the most
    repeated piece of a document was drawn (which max_repeats caps)."""
    pieces = draw.groupBy("source", "doc_id", "first_token", "block").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("times"))
    got = pieces.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("times").alias("most_repeats"), F.countDistinct("doc_id").alias("documents"))
    rows = targets.where(F.col("source").isNotNull()).join(got, "source", "left")
    rows = rows.withColumn("total", F.sum("tokens").over(W.partitionBy(F.lit(1))))  # a row for each target
    return rows.select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share_of_draw"), F.coalesce(F.col("tokens") / F.lit(max(1, aimed_tokens)), F.lit(0.0)).alias("share_of_aim"),
    )
