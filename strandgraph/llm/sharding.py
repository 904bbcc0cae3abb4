"""Minimum-cost-flow resharding.

Given the bytes that old shards hold and the capacities of new ones, a minimum-cost
flow finds the transfers that move the fewest bytes. Old shards are cut into blocks of
rows; the plan of each shard is a list of byte ranges over its blocks in order, so that
only blocks at a range's edge are split, by row. Only rows that move, and so only files
of shards that gain or lose rows, are written anew.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, delete, table

#: Rows of a block if one old shard held all of them, and the fewest blocks of an old shard.
BLOCK_ROWS, LEAST_BLOCKS = 200_000, 64
#: Up to so many blocks (a few numbers each) are broadcast to the rows; more are joined by shuffle.
BROADCAST_BLOCKS = 100_000


def min_cost_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts from each supply to each room, all supply placed at the least cost: successive shortest
    paths with potentials. For some tens or hundreds of shards; rooms must add up to the supply or more."""
    n, m = len(supply), len(room)
    s, t = n + m, n + m + 1
    edges: list[list[int]] = []  # to, capacity, cost; the reverse edge follows
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, capacity: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, capacity, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, x in enumerate(supply):
        add(s, i, x, 0)
    for j, x in enumerate(room):
        add(n + j, t, x, 0)
    at = {}
    for i in range(n):
        for j in range(m):
            at[i, j] = len(edges)
            add(i, n + j, supply[i], cost[i][j])
    potential = [0] * (n + m + 2)
    left = sum(supply)
    while left:
        dist, via = {s: 0}, {}
        heap = [(0, s)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                b, capacity, price = edges[e]
                if capacity and d + price + potential[a] - potential[b] < dist.get(b, 1 << 62):
                    dist[b] = d + price + potential[a] - potential[b]
                    via[b] = e
                    heapq.heappush(heap, (dist[b], b))
        if t not in dist:
            raise ValueError("the capacities are smaller than the shards")
        far = max(dist.values())
        for a in range(len(potential)):
            potential[a] += dist.get(a, far)
        push, a = left, t
        while a != s:
            push = min(push, edges[via[a]][1])
            a = edges[via[a] ^ 1][0]
        a = t
        while a != s:
            edges[via[a]][1] -= push
            edges[via[a] ^ 1][1] += push
            a = edges[via[a] ^ 1][0]
        left -= push
    return [[edges[at[i, j] + 1][1] for j in range(m)] for i in range(n)]


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def reshard(rows: DataFrame, old: Column, size: Column, order: list[Column], shards: int, old_shards: int, capacities: list[int] | None = None, blocks: int | None = None) -> DataFrame:
    """rows with old_shard, size, shard and slot; sizes per shard meet the capacities within one row.

    Without capacities, shards get equal bytes. old must be 0 to old_shards - 1. Within a shard, slots
    are gapless from 0; rows whose order columns tie may swap slots. An empty table gives an empty result.
    Columns of rows that have one of the four new names are replaced; any other name may occur. The driver
    gets one number for each old shard.
    """
    names = [n for n in rows.columns if n not in ("old_shard", "size", "shard", "slot")]
    held = checkpoint(
        rows.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)], old.cast("int").alias("old_shard"), size.cast("long").alias("size"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
        .withColumn("row", F.monotonically_increasing_id())
    )
    blocks = blocks or max(LEAST_BLOCKS, -(-held.count() // BLOCK_ROWS))
    held = held.withColumn("block", F.pmod(F.xxhash64("row", F.lit(11)), F.lit(blocks)).cast("int"))
    keys = [*[f"o{i}" for i in range(len(order))], "row"]
    small = F.broadcast if blocks * max(shards, old_shards) <= BROADCAST_BLOCKS else lambda df: df
    sums = checkpoint(held.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")))
    supply = [0] * old_shards
    for r in sums.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect():
        supply[r["old_shard"]] = r["bytes"]
    if capacities is None:
        total = sum(supply)
        capacities = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    flow = min_cost_flow(supply, capacities, [[int(i != j) for j in range(shards)] for i in range(old_shards)])
    # Byte ranges of each old shard, its own share first: a row goes where its first byte lies.
    ranges = []
    for i, to in enumerate(flow):
        at = 0
        for j in sorted(range(shards), key=lambda j, i=i: (j != i, j)):
            if to[j]:
                ranges.append((i, at, at + to[j], j))
                at += to[j]
    plan = rows.sparkSession.createDataFrame(ranges, "old_shard int, low long, high long, shard int").groupBy("old_shard").agg(F.collect_list(F.struct("low", "high", "shard")).alias("plan"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("old_shard", "block", F.coalesce(F.sum("bytes").over(earlier("old_shard").orderBy("block")), F.lit(0)).alias("begin"))
    # The plan has one row for each old shard, of at most `shards` ranges.
    placed = (
        held.join(small(starts), ["old_shard", "block"])
        .withColumn("at", F.col("begin") + F.coalesce(F.sum("size").over(earlier("old_shard", "block").orderBy(*keys)), F.lit(0)))
        .join(F.broadcast(plan), "old_shard")
        .withColumn("shard", F.filter("plan", lambda p: (p["low"] <= F.col("at")) & (F.col("at") < p["high"]))[0]["shard"])
        .drop("plan", "begin", "at")
    )
    placed = checkpoint(placed)
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier("shard").orderBy("old_shard", "block")), F.lit(0))).drop("n")
    numbered = placed.join(small(offsets), ["shard", "old_shard", "block"]).withColumn(
        "slot", F.col("offset") + F.row_number().over(Window.partitionBy("shard", "old_shard", "block").orderBy(*keys)) - 1
    )
    return numbered.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "old_shard", "size", "shard", F.col("slot").cast("long").alias("slot"))


def rewrite_affected(placed: DataFrame, path: str) -> None:
    """Writes the shards that gained or lost rows, each to a folder shard=N of its own; other shards' files stay.

    A shard that lost all its rows loses its folder, after the others are written. Written again after
    a failure between the two, the result is the same. Old shards and shards are one per folder, so few.
    """
    placed = checkpoint(placed)
    moved = placed.where("shard <> old_shard")
    changed = {r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()}
    rows = placed.where(F.col("shard").isin(sorted(changed)))
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("shard").parquet(path)
    left = changed - {r[0] for r in rows.select("shard").distinct().collect()}
    for shard in sorted(left):
        delete(placed.sparkSession, f"{path}/shard={shard}")


def op4_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards of near equal bytes; the old shard is the source's hash, so a hot source makes one of them much too large."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text_bytes(F.col("text")).alias("bytes"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(16))
    placed = reshard(docs, old, F.col("bytes"), [F.col("doc_id"), F.col("bytes"), F.col("text_crc32")], 16, 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES = {"op4_min_cost_resharding": op4_min_cost_resharding}
SQL: dict[str, str] = {}
