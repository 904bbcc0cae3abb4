"""Average-linkage clustering of sparse similarities, cuts of the dendrogram and their silhouettes, all as tables.

Pairs that aren't listed have similarity 0 (distance 1), so only listed pairs are stored. The mean distance of two clusters is 1 less
the sum of their pairs' similarities over the number of pairs, and these sums add up as clusters merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Rounds, connected_components, cut
from .scan import running

def similarities(distances: DataFrame) -> DataFrame:
    """a < b, s = 1 - distance of pairs nearer than 1."""
    return distances.where("a <> b and distance < 1").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((1 - F.min("distance")).alias("s"))


def average_linkage(items: DataFrame, distances: DataFrame) -> DataFrame:
    """The dendrogram: a row for each merge of two clusters, each named by its smallest item: a < b, height (their mean distance), size, pairs (between them), similarity (sum over these).

    items: id. distances: a, b, distance (0 to 1) of some pairs, others being at 1. Each round merges all pairs of clusters that are each other's
    nearest: with mean distances none of these merges brings a third cluster nearer, so the dendrogram is the one of
    single steps. Distances that agree to 12 digits are equal, and ties go to the pair of smaller names. What is left without similarity
    merges in order of names at height 1.
    """
    rounds = Rounds(items.sparkSession)
    now = rounds.put("now", similarities(distances))
    sizes = rounds.put("sizes", items.select(F.col("id").alias("c"), F.lit(1).cast("long").alias("n")).distinct())
    merges = None
    while True:
        rows = now.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").withColumn("pairs", F.col("na") * F.col("nb"))
        rows = rounds.put("rows", rows.withColumn("height", F.round(1 - F.col("s") / F.col("pairs"), 12)))
        if rows.isEmpty():
            break
        nearest = rows.select(F.struct("height", "a", "b").alias("p"), F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.min("p").alias("p"))
        mutual = nearest.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.a", "p.b")
        step = rounds.put("step", rows.join(mutual, ["a", "b"]).select("a", "b", "height", (F.col("na") + F.col("nb")).alias("size"), "pairs", F.col("s").alias("similarity")))
        merges = rounds.put("merges", step if merges is None else merges.union(step))
        renamed = step.select(F.col("b").alias("old"), F.col("a").alias("new"))
        left, right = renamed.toDF("a", "new_a"), renamed.toDF("b", "new_b")
        other = rows.select("a", "b", "s").join(left, "a", "left").join(right, "b", "left").select(F.coalesce("new_a", "a").alias("x"), F.coalesce("new_b", "b").alias("y"), "s")
        now = rounds.put("now", other.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s")))
        sizes = rounds.put("sizes", sizes.join(renamed.toDF("c", "new"), "c", "left").groupBy(F.coalesce("new", "c").alias("c")).agg(F.sum("n").alias("n")))
    grown = running(sizes, [F.asc("c")], "n", "sum", "size")
    first = sizes.agg(F.min("c").alias("a"))
    rest = grown.crossJoin(F.broadcast(first)).where(F.col("c") != F.col("a"))
    last = rest.select("a", F.col("c").alias("b"), F.lit(1.0).alias("height"), "size", ((F.col("size") - F.col("n")) * F.col("n")).alias("pairs"), F.lit(0.0).alias("similarity"))
    return rounds.result(last if merges is None else merges.union(last))


def cophenetic_correlation(merges: DataFrame, distances: DataFrame) -> DataFrame:
    """One row: correlation of the distances of all pairs with the heights at which they join.

    Every pair joins at one merge, so the sums over all pairs are sums over merges: none is listed.
    """
    own = similarities(distances).agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("ss"))
    pairs, s, h = (F.col(c) for c in ("pairs", "similarity", "height"))
    sums = merges.agg(F.sum(pairs).alias("n"), F.sum(s).alias("s"), F.sum(h * pairs).alias("h"), F.sum(h * h * pairs).alias("hh"), F.sum(h * s).alias("hs"))
    n = F.col("n")
    # With distance 1 - s, the correlation is that of s with the opposite sign.
    covariance = F.col("hs") - F.col("h") * F.col("s") / n
    spread = F.sqrt((F.col("ss") - F.col("s") * F.col("s") / n) * (F.col("hh") - F.col("h") * F.col("h") / n))
    return sums.crossJoin(F.broadcast(own)).select((-F.try_divide(covariance, spread)).alias("correlation"))


def cuts(items: DataFrame, merges: DataFrame, sizes: list[int]) -> DataFrame:
    """k, id, cluster (its smallest item) for each number of clusters k asked for: merges up to the height of the k-th from the top count; equal
    heights stay together, so there may be fewer clusters. Items of fewer than k merges stay alone."""
    spark = items.sparkSession
    top = [r[0] for r in merges.orderBy(F.desc("height")).limit(max(sizes)).select("height").collect()]
    known = spark.createDataFrame([(k, top[k - 1]) for k in sizes if k <= len(top)], "k int, most double")
    end = lambda c: F.struct("k", F.col(c).alias("id"))
    joins = merges.join(F.broadcast(known), F.col("height") <= F.col("most")).select(end("a").alias("u"), end("b").alias("v"))
    joined = connected_components(joins).select("node.k", "node.id", F.col("component.id").alias("cluster"))
    each = items.select("id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in sizes], "k int")))
    return each.join(joined, ["k", "id"], "left").select("k", "id", F.coalesce("cluster", "id").alias("cluster"))


def cut_into(items: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """id, cluster of at most k clusters."""
    return cuts(items, merges, [k]).drop("k")


def silhouettes(labels: DataFrame, distances: DataFrame) -> DataFrame:
    """k, clusters, silhouette (mean over the items) of labels (k, id, cluster); an item alone has 0, one cluster only has null.

    Mean distances come from an item's sums of similarities to each cluster that it has any with; any other cluster is at 1.
    """
    labels = cut(labels)
    sizes = labels.groupBy("k", "cluster").agg(F.count("*").alias("n"))
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    rows = similarities(distances).select(F.explode(ends).alias("e"), "s").select("e.*", "s").join(labels.select("k", F.col("id").alias("other"), "cluster"), "other")
    sums = rows.groupBy("k", "id", "cluster").agg(F.sum("s").alias("s")).join(sizes, ["k", "cluster"]).join(labels.withColumnRenamed("cluster", "own"), ["k", "id"])
    same = F.col("cluster") == F.col("own")
    means = sums.groupBy("k", "id").agg(F.sum(F.when(same, F.col("s"))).alias("inside"), F.max(F.when(~same, F.col("s") / F.col("n"))).alias("nearest"))
    each = labels.join(sizes, ["k", "cluster"]).join(means, ["k", "id"], "left")
    a = 1 - F.coalesce("inside", F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0))
    b = 1 - F.coalesce("nearest", F.lit(0.0))
    width = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    out = each.groupBy("k").agg(F.count_distinct("cluster").alias("clusters"), F.avg(width).alias("silhouette"))
    return out.withColumn("silhouette", F.when(F.col("clusters") > 1, F.col("silhouette")))


def best_cut(items: DataFrame, merges: DataFrame, distances: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """k, clusters, silhouette, best: each number of clusters asked for, and whether it is the first of the greatest silhouette."""
    out = cut(silhouettes(cuts(items, merges, list(range(least, most + 1))), distances))
    best = out.where("silhouette is not null").agg(F.max_by("k", F.struct(F.round("silhouette", 12), -F.col("k"))).alias("best_k"))
    return out.crossJoin(F.broadcast(best)).select("k", "clusters", "silhouette", F.coalesce(F.col("k") == F.col("best_k"), F.lit(False)).alias("best"))
