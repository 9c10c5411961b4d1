"""Mixes of sources to target shares, drawn as fixed-length token blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.runtime import cut

BLOCK_TOKENS = 512
#: Slots of one output shard.
SHARD_SLOTS = 1024
#: Documents of one bucket, whose tokens are laid end to end.
BUCKET_DOCS = 20_000


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each ``index`` in a pseudorandom permutation of 0..size-1 that ``key`` selects.

    A balanced Feistel network over the next even power of two, walked until it lands inside; a bijection for every size and key.
    """
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            m, h, k = mask[todo], half[todo], key[todo]
            left, right = x[todo] >> h, x[todo] & m
            for turn in range(4):
                z = (right + k + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((z >> np.uint64(32)) & m)
            x[todo] = left << h | right
            todo[todo] = x[todo] >= size[todo]
    return x.astype(np.int64)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lay_blocks(sizes: DataFrame, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(pieces, blocks and tokens per source) of documents with ``doc_id``, ``source`` and ``n_tokens``.

    The tokens of a source's documents lie end to end and are cut into blocks, of which only the last may be short.  Places are summed up within buckets of about ``BUCKET_DOCS``
    documents, then over buckets, so no task holds a whole source.  A piece is what one document gives to one block: ``source, block, doc_id, n_tokens``.
    """
    docs = sizes.where("doc_id is not null and source is not null and n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.*")
    docs = cut(docs)
    counts = cut(docs.groupBy("source").agg(F.ceil(F.count("*") / BUCKET_DOCS).alias("buckets")))
    spread = docs.join(small(counts), "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), "buckets"))
    own = Window.partitionBy("source", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = spread.withColumn("start", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    filled = cut(spread.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    placed = laid.join(small(offsets), ["source", "bucket"]).select("source", "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)
    pieces = placed.select("source", "doc_id", "start", "n_tokens", F.explode(F.sequence(first, last)).alias("block"))
    end = F.least((F.col("block") + 1) * block, F.col("start") + F.col("n_tokens"))
    return (
        pieces.select("source", "block", "doc_id", (end - F.greatest(F.col("block") * block, F.col("start"))).cast("bigint").alias("n_tokens")),
        filled.groupBy("source").agg(F.sum("tokens").alias("tokens")).withColumn("blocks", F.ceil(F.col("tokens") / block).cast("bigint")),
    )


def plan_mixes(blocks: DataFrame, totals: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS) -> pd.DataFrame:
    """What each mix wants of each source, in tokens and blocks: one row a target, so a bounded table of parameters.

    A quota is as many whole uses of the source as the wanted tokens hold and the blocks that the rest fills, so it is met within a block however short the last one is.
    """
    wanted = (
        targets.where("mix_id is not null and source is not null and target_share > 0")
        .groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max(F.greatest(F.col("max_repeats"), F.lit(0))).alias("max_repeats"), F.max("budget_share").alias("budget_share"))
        .join(blocks, "source", "left").na.fill(0, ["blocks", "tokens"]).orderBy("mix_id", "source").toPandas()
    )
    total = totals.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    wanted["max_repeats"] = wanted["max_repeats"].fillna(1).astype("int64")
    wanted["target_tokens"] = np.rint(wanted["target_share"].astype(float) * wanted["budget_share"].astype(float) * float(total)).astype("int64")
    have = np.maximum(wanted["tokens"].astype("int64"), 1)
    whole = wanted["target_tokens"] // have
    rest = np.minimum(np.rint((wanted["target_tokens"] - whole * have) / block).astype("int64"), wanted["blocks"].astype("int64"))
    wanted["quota"] = np.minimum(whole * wanted["blocks"].astype("int64") + rest, wanted["blocks"].astype("int64") * wanted["max_repeats"])
    return wanted


def draw_slots(spark, wanted: pd.DataFrame, seed: int) -> DataFrame:
    """``mix_id, source, shard, epoch, block`` of every slot of every mix.

    Each output shard draws its counts of the sources from a multinomial of their quotas' shares.  The draws' excess over a source's quota then goes
    to sources that came short, so each source ends with its quota exactly.  A source's slots, numbered over all shards, pass through a
    pseudorandom permutation of its blocks, a new one each time all blocks are used up, so no block serves more than its allowed times.
    """
    plan = {int(m): g.reset_index(drop=True) for m, g in wanted[wanted["quota"] > 0].groupby("mix_id")}
    shards = [(m, j) for m, g in plan.items() for j in [-(-int(g["quota"].sum()) // SHARD_SLOTS)]]
    if not shards:
        return spark.createDataFrame([], "mix_id int, source string, shard bigint, epoch bigint, block bigint")
    ranges = None
    for m, n in shards:
        part = spark.range(n).select(F.lit(m).alias("mix_id"), F.col("id").alias("shard"))
        ranges = part if ranges is None else ranges.unionByName(part)

    def counts_of(m: int, shard: int) -> np.ndarray:
        g = plan[m]
        quota = g["quota"].to_numpy()
        slots = min(SHARD_SLOTS, int(quota.sum()) - shard * SHARD_SLOTS)
        return np.random.default_rng([seed, m, shard]).multinomial(slots, quota / quota.sum())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, j, i, int(c)) for m, j in zip(pdf["mix_id"], pdf["shard"]) for i, c in enumerate(counts_of(int(m), int(j))) if c]
            yield pd.DataFrame(rows, columns=["mix_id", "shard", "place", "drawn"])

    drawn = cut(ranges.mapInPandas(draw, "mix_id int, shard bigint, place int, drawn bigint"))
    got = {(r[0], r[1]): r[2] for r in drawn.groupBy("mix_id", "place").agg(F.sum("drawn")).collect()}
    # Excess slots of each mix are numbered; the intervals say which source takes over.
    moves = {}
    for m, g in plan.items():
        extra = np.array([got.get((m, i), 0) for i in g.index]) - g["quota"].to_numpy()
        moves[m] = (np.concatenate([[0], np.cumsum(np.maximum(extra, 0))]), np.concatenate([[0], np.cumsum(np.maximum(-extra, 0))]))
    before = Window.partitionBy("mix_id", "place", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # Running totals in two steps, so that no task holds all shards of a source.
    grouped = drawn.withColumn("group", F.floor(F.col("shard") / 4096))
    inside = grouped.withColumn("start", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    sums = grouped.groupBy("mix_id", "place", "group").agg(F.sum("drawn").alias("sum"))
    base = sums.withColumn("base", F.coalesce(F.sum("sum").over(Window.partitionBy("mix_id", "place").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = inside.join(base.select("mix_id", "place", "group", "base"), ["mix_id", "place", "group"]).select("mix_id", "shard", "place", "drawn", (F.col("start") + F.col("base")).alias("start"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for m, shard, i, n, start in zip(pdf["mix_id"], pdf["shard"], pdf["place"], pdf["drawn"], pdf["start"]):
                g, (over, short) = plan[m], moves[m]
                quota, size = g["quota"].to_numpy(), g["blocks"].to_numpy()
                ordinal, who = np.arange(start, start + n), np.full(n, i)
                late = ordinal >= quota[i]
                nth = ordinal[late] - quota[i] + over[i]
                takes = np.searchsorted(short, nth, side="right") - 1
                who[late] = takes
                kept = quota[takes] - (short[takes + 1] - short[takes])
                ordinal[late] = kept + nth - short[takes]
                epoch = ordinal // size[who]
                key = (np.uint64(seed) + np.uint64(m) * np.uint64(1_000_003) + who.astype(np.uint64) * np.uint64(7919)) * np.uint64(65537) + epoch.astype(np.uint64)
                out.append(pd.DataFrame({"mix_id": m, "source": g["source"].to_numpy()[who], "shard": shard, "epoch": epoch, "block": permuted(ordinal % size[who], size[who], key)}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["mix_id", "source", "shard", "epoch", "block"])

    return numbered.mapInPandas(place, "mix_id int, source string, shard bigint, epoch bigint, block bigint")


def mix_pages(sizes: DataFrame, targets: DataFrame, seed: int = 11, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(chosen pages, report) of every mix of ``targets``.

    ``sizes`` has ``doc_id, source, n_tokens``; ``targets`` has ``mix_id, source, target_share, max_repeats, budget_share``.  A mix wants ``budget_share`` of all
    tokens, documents without source included.  Chosen pages: ``mix_id, source, doc_id, use_no, n_tokens``, the tokens that use number ``use_no`` of
    the page supplies; a page's uses never exceed ``max_repeats``.  The report has a row a target with the actual share and the shortfall in tokens,
    also for targets without pages.  Null ids, null sources and documents without tokens join no mix.  Repeated ids count once.
    """
    sizes = cut(sizes.select("doc_id", "source", "n_tokens"))
    spark = sizes.sparkSession
    named = targets.where("source is not null").select("source").distinct()
    pieces, blocks = lay_blocks(sizes.join(small(named), "source", "left_semi"), block)
    wanted = plan_mixes(blocks, sizes.dropDuplicates(["doc_id"]), targets, block)
    slots = draw_slots(spark, wanted, seed)
    used = slots.groupBy("mix_id", "source", "epoch", "block").agg(F.count("*").alias("n"))
    pages = (
        used.join(pieces, ["source", "block"]).groupBy("mix_id", "source", "doc_id", F.col("epoch").cast("int").alias("use_no")).agg(F.sum("n_tokens").alias("n_tokens"))
    )
    pages = cut(pages)
    actual = pages.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("actual_tokens"), F.count_distinct("doc_id").alias("pages"), F.max(F.col("use_no") + 1).alias("most_uses"))
    plan = spark.createDataFrame(
        [(int(r.mix_id), str(r.source), float(r.target_share), int(r.max_repeats), int(r.target_tokens)) for r in wanted.itertuples()],
        "mix_id int, source string, target_share double, max_repeats int, target_tokens bigint",
    )
    report = plan.join(actual, ["mix_id", "source"], "left").na.fill(0, ["actual_tokens", "pages", "most_uses"])
    whole = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    return pages, report.select(
        "mix_id", "source", "target_share", F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(0.0).alias("actual_share"), "target_tokens", "actual_tokens",
        F.greatest(F.col("target_tokens") - F.col("actual_tokens"), F.lit(0)).alias("shortfall_tokens"), "pages", "most_uses", "max_repeats",
    )
