"""Communities by modularity and betweenness of weighted networks, as rounds of joins over edge tables.

Edges are undirected rows (a, b, w) of positive weight; repeats of an edge add up, and null ends or weights leave a row out. Each
round's tables are written and read again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Rounds, connected_components, numbered

#: Gains and path lengths that differ by less are equal.
EQUAL = 1e-12
#: (source, node) rows of the shortest paths of one batch of sources.
BATCH_ROWS = 50_000_000


def simple(edges: DataFrame) -> DataFrame:
    """a <= b, w: each edge once."""
    clean = edges.where("a is not null and b is not null and w > 0")
    return clean.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("w").cast("double")).alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """u, v, w: each edge between two nodes from either end."""
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.where("a <> b").select(F.explode(ends).alias("e"), "w").select("e.u", "e.v", "w")


# --- communities


def moved(both: DataFrame, strength: DataFrame, m: float, rounds: Rounds) -> tuple[DataFrame, bool]:
    """id, c after local moves (each node starts in a community of its own), and whether any node moved.

    A round takes each node's best move by modularity gain, and carries out those that are the best move of both
    communities they touch: such moves share no community, so their gains add up and modularity rises by each. The best move of all
    is always among them.
    """
    member, any_moved = rounds.put("member", strength.select("id", F.col("id").alias("c"))), False
    while True:
        own = strength.join(member, "id")
        totals = own.groupBy("c").agg(F.sum("k").alias("total"))
        to = both.join(member.toDF("v", "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
        here = own.join(totals, "c").select(F.col("id").alias("u"), F.col("c").alias("from"), "k", F.col("total").alias("left"))
        inside = to.select("u", F.col("c").alias("from"), F.col("w").alias("own"))
        rows = to.join(here, "u").where(F.col("c") != F.col("from")).join(inside, ["u", "from"], "left").join(totals, "c")
        gain = (F.col("w") - F.coalesce("own", F.lit(0.0))) / m - F.col("k") * (F.col("total") - F.col("left") + F.col("k")) / (2 * m * m)
        order = F.struct((-F.round(gain, 12)).alias("gain"), F.col("u").alias("u"), F.col("c").alias("c"), F.col("from").alias("from"))
        best = rounds.put("best", rows.groupBy("u").agg(F.min(order).alias("move")).where(F.col("move.gain") < -EQUAL).select("move"))
        if best.isEmpty():
            return member, any_moved
        touched = best.select("move", F.explode(F.array("move.c", "move.from")).alias("c")).groupBy("c").agg(F.min("move").alias("move"))
        agreed = touched.groupBy("move").agg(F.count("*").alias("n")).where("n = 2").select(F.col("move.u").alias("id"), F.col("move.c").alias("new"))
        member = rounds.put("member", member.join(agreed, "id", "left").select("id", F.coalesce("new", "c").alias("c")))
        any_moved = True


def strengths(edges: DataFrame) -> DataFrame:
    """id, k: weight of a node's edge ends."""
    return edges.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("k"))


def louvain(edges: DataFrame) -> DataFrame:
    """id, community (its smallest member) of each node that has an edge, by levels of local moves and contraction.

    At each level nodes move while modularity rises, then communities become nodes, their inner edges loops, until a level moves none. Ties go to the smaller
    node, then the smaller community, so the result is the same in every run. A graph without edges gives no rows.
    """
    rounds = Rounds(edges.sparkSession)
    now = rounds.put("edges", simple(edges))
    total = now.agg(F.sum("w")).first()[0]
    label = rounds.put("label", now.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("c", F.col("id")))
    while total:
        member, any_moved = moved(rounds.put("both", both_ways(now)), rounds.put("strength", strengths(now)), total, rounds)
        if not any_moved:
            break
        label = rounds.put("label", label.join(member.toDF("c", "to"), "c").select("id", F.col("to").alias("c")))
        contracted = now.join(member.toDF("a", "ca"), "a").join(member.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w")
        now = rounds.put("edges", simple(contracted))
    names = label.groupBy("c").agg(F.min("id").alias("community"))
    return rounds.result(label.join(names, "c").select("id", "community"))


def numbered_communities(member: DataFrame, frequency: DataFrame) -> DataFrame:
    """id, community numbered from 0 by falling size, then its most frequent member's frequency, then that member's name.

    frequency: id, n; a node without one has 0.
    """
    rows = member.join(frequency.select("id", F.col("n").alias("f")), "id", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    first = rows.groupBy("community").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("f")).alias("f"), "id")).alias("lead"))
    order = numbered(first, [F.desc("size"), F.asc("lead.f"), F.asc("lead.id")], "place")
    return rows.join(order.select("community", "place"), "community").select("id", F.col("place").alias("community"))


# --- betweenness


def shortest(both: DataFrame, sources: DataFrame, rounds: Rounds) -> DataFrame:
    """s, v, d: the length of the shortest path from each source s to each node that it reaches; both has u, v, length."""
    reached = front = rounds.put("reached", sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d")))
    while True:
        near = front.join(both.withColumnRenamed("v", "to"), F.col("v") == F.col("u")).groupBy("s", "to").agg(F.min(F.col("d") + F.col("length")).alias("d")).withColumnRenamed("to", "v")
        old = reached.withColumnRenamed("d", "old")
        front = rounds.put("front", near.join(old, ["s", "v"], "left").where(F.col("old").isNull() | (F.col("d") < F.col("old") * (1 - EQUAL))).select("s", "v", "d"))
        if front.isEmpty():
            return reached
        reached = rounds.put("reached", reached.union(front).groupBy("s", "v").agg(F.min("d").alias("d")))


def carried(start: DataFrame, steps: DataFrame, step_from: str, step_to: str, name: str, rounds: Rounds) -> DataFrame:
    """s, v, x: what start gives (s, v, x), and what each step (source, from, to, factor) passes on, over all walks of a graph without cycles."""
    front = rounds.put(f"{name}_front", start)
    total = rounds.put(name, start)
    while True:
        on = (F.col("s") == F.col("source")) & (F.col("v") == F.col(step_from))
        front = rounds.put(f"{name}_front", front.join(steps, on).groupBy("source", step_to).agg(F.sum(F.col("x") * F.col("factor")).alias("x")).toDF("s", "v", "x"))
        if front.isEmpty():
            return total
        total = rounds.put(name, total.union(front).groupBy("s", "v").agg(F.sum("x").alias("x")))


def dependencies(both: DataFrame, sources: DataFrame, rounds: Rounds) -> DataFrame:
    """v, x: over the sources s, the sum of the shares of shortest paths from s that pass through v on their way to other nodes."""
    reached = shortest(both, sources, rounds)
    ends = reached.toDF("source", "to", "far")
    steps = reached.toDF("source", "from", "d").join(both.toDF("from", "to", "length"), "from").join(ends, ["source", "to"])
    tight = rounds.put("tight", steps.where(F.abs(F.col("d") + F.col("length") - F.col("far")) <= EQUAL * F.col("far")).select("source", "from", "to", F.lit(1.0).alias("factor")))
    paths = carried(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("x")), tight, "from", "to", "paths", rounds)
    of = lambda end, name: paths.toDF("source", end, name)
    shares = tight.drop("factor").join(of("from", "n_from"), ["source", "from"]).join(of("to", "n_to"), ["source", "to"])
    shares = rounds.put("shares", shares.select("source", "from", "to", (F.col("n_from") / F.col("n_to")).alias("factor")))
    each = carried(reached.select("s", "v", F.lit(1.0).alias("x")), shares, "to", "from", "passed", rounds)
    # Each node's own 1 goes out again: it is no path that passes.
    return each.where("s <> v").groupBy("v").agg(F.sum(F.col("x") - 1).alias("x"))


def betweenness(edges: DataFrame, n_nodes: int | None = None, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """id, betweenness of each node that has an edge: the share of shortest paths between two other nodes that pass through it, an edge being 1 / w long.

    All nodes are sources, in batches: a node's rows are as many as its component's nodes, so the components' sizes tell how many
    batches keep each under batch_rows. n_nodes counts isolated nodes, too (default: nodes with an edge); of fewer than three all are 0.
    """
    rounds = Rounds(edges.sparkSession)
    now = rounds.put("edges", simple(edges))
    both = rounds.put("both", both_ways(now).select("u", "v", (1 / F.col("w")).alias("length")))
    nodes = rounds.put("nodes", now.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sizes = connected_components(now, "a", "b").groupBy("component").agg(F.count("*").alias("n"))
    count, rows = nodes.count(), sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    batches = max(1, math.ceil(rows / batch_rows))
    out = rounds.put("out", nodes.select(F.col("id").alias("v"), F.lit(0.0).alias("x")))
    for batch in range(batches):
        sources = nodes.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch).select(F.col("id").alias("s"))
        found = dependencies(both, sources, rounds)
        out = rounds.put("out", out.union(found).groupBy("v").agg(F.sum("x").alias("x")))
    n = n_nodes or count
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return rounds.result(out.select(F.col("v").alias("id"), (F.col("x") * scale).alias("betweenness")))
