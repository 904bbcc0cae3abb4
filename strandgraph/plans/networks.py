"""Queries over the item network: communities, betweenness, the dendrogram and the choice of its cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import mining as M
from ..operators import network as N
from ..operators.graph import cut
from .analytics import baskets
from .registry import query


def item_frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("item").alias("id")).agg(F.count("*").alias("n"))


@query("g10_communities")
def g10(spark: SparkSession, d: str) -> DataFrame:
    """Communities of items that 13 baskets or more share, numbered by size and leading item."""
    rows = baskets(spark, d)
    edges = M.cooccurrence(rows, "basket", "item", 13).withColumnRenamed("n", "w")
    return N.numbered_communities(N.louvain(edges), item_frequency(rows)).withColumnRenamed("id", "item")


@query("g12_betweenness")
def g12(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness of all items in the network of 13 shared baskets or more, an edge being as long as its number is small."""
    rows = baskets(spark, d)
    edges = M.cooccurrence(rows, "basket", "item", 13).withColumnRenamed("n", "w")
    found = N.betweenness(edges, rows.select("item").distinct().count())
    return found.select(F.col("id").alias("item"), F.round("betweenness", 9).alias("betweenness"))


def dendrogram(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, distances, merges) of the items' baskets."""
    rows = cut(baskets(spark, d))
    items, distances = rows.select(F.col("item").alias("id")).distinct(), cut(M.jaccard_distances(rows, "basket", "item"))
    return items, distances, K.average_linkage(items, distances)


@query("g16_linkage")
def g16(spark: SparkSession, d: str) -> DataFrame:
    _, distances, merges = dendrogram(spark, d)
    told = K.cophenetic_correlation(merges, distances)
    return merges.crossJoin(F.broadcast(told)).select("a", "b", F.round("height", 9).alias("height"), "size", F.round("correlation", 9).alias("correlation"))


@query("g17_cluster_choice")
def g17(spark: SparkSession, d: str) -> DataFrame:
    items, distances, merges = dendrogram(spark, d)
    return K.best_cut(items, merges, distances).withColumn("silhouette", F.round("silhouette", 9))
