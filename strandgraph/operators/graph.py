"""Components, subgraphs, modularity and communities."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph
from .pattern import degree, endpoints, known_edges


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only a local session without one (tests) gets a folder of its own.
    """
    context = spark.sparkContext
    shared = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        shared = tempfile.mkdtemp(dir="/tmp/checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared


#: The folders of the checkpoints made since the innermost `passing_cuts` was entered; None outside.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the cluster's shared checkpoint folder and cuts its lineage there."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    if (made := _passing.get()) is not None:
        made.append(out._jdf.logicalPlan().rdd().getCheckpointFile().get())
    return out


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any file system that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[None]:
    """Deletes the checkpoints made within once it is left, whether by its end or by an error.

    What is computed from them has to be written before: nothing that is still to run may read them.
    """
    token = _passing.set(made := [])
    try:
        yield
    finally:
        _passing.reset(token)
        for folder in made:
            delete(spark, folder)


class Rounds:
    """Tables of a loop's rounds, each written to the shared folder and read again.

    That cuts the lineage and tells the planner real sizes: its own estimates multiply at each join, over rounds to numbers too long to compute with. A name holds its
    last table, the one before is deleted, so nothing that is still to run may read that.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.held = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", {}

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        old, path = self.held.get(name), f"{self.folder}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.held[name] = path
        if old:
            delete(self.spark, old)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        return gathered(kept, kept.count())

    def result(self, rows: DataFrame) -> DataFrame:
        """rows cut from all tables, which go."""
        out = cut(rows)
        delete(self.spark, self.folder)
        return out


#: Rows of narrow columns (two or three ids) that one task takes in its stride.
TASK_ROWS = 250_000


def gathered(rows: DataFrame, count: int) -> DataFrame:
    """rows, of which there are `count`, in partitions of about TASK_ROWS at least; all of a small table in one, whose groups and joins
    then need no shuffle. Larger tables keep their partitions."""
    return rows.coalesce(max(1, math.ceil(count / TASK_ROWS)))


def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """rows by their keys over so many partitions that of `count` rows about TASK_ROWS meet in one: what a task holds doesn't grow with a table."""
    return rows.repartition(max(1, math.ceil(count / TASK_ROWS)), *keys)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns node, component.

    Alternates the large-star and small-star steps, so that a chain of n nodes needs
    about log(n) rounds. Edges with a null end and self-loops connect nothing; nodes
    without another edge are left out. Node ids may be of any ordered type. Adjacency
    is never gathered: each step is a pre-aggregated minimum and an inner join, which
    adaptive execution splits where one node has very many edges.
    """
    now = cut(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        now = gathered(now, mark[0])
        both = _pairs(now, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _pairs(large.join(low, "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct()
        now = cut(small)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct()).toDF("node", "component")


def _pairs(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """u, v: each of some pairs of columns of each row, in the row's own partition."""
    pairs = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])
    return rows.select(F.explode(pairs).alias("e")).select("e.u", "e.v")


def _mark(edges: DataFrame) -> tuple:
    """Number and hash sum of edges: equal if, but for chance, the edges are."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id it reaches) of each node at an edge to another, edges taken as undirected."""
    return connected_components(edges, "subject_id", "object_id").toDF("id", "root")


def components(graph: Graph) -> DataFrame:
    """id, component, size; numbered from 0 by falling size, then smallest id. Nodes without edges are components;
    self-loops and edges to unknown nodes join nothing."""
    edges = known_edges(graph.edges, graph.nodes)
    member = graph.nodes.select("id").join(roots(edges), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    sizes = member.groupBy("root").agg(F.count("*").alias("size"))
    return member.join(numbered(sizes, [F.desc("size"), F.asc("root")], "component"), "root").select("id", "component", "size")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 0 in a total order: sorted by range, numbered within partitions, and shifted by the
    rows of the partitions before, of which there are few."""
    ordered = cut(rows.orderBy(*order).withColumn("__p", F.spark_partition_id()))
    shifts, shift = [], 0
    for p, n in ordered.groupBy("__p").count().orderBy("__p").collect():
        shifts.append((p, shift))
        shift += n
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    shifts = rows.sparkSession.createDataFrame(shifts, "__p int, __shift long")
    return ordered.withColumn("__r", within).join(F.broadcast(shifts), "__p").withColumn(name, F.col("__shift") + F.col("__r") - 1).drop("__p", "__r", "__shift")


def topology(members: DataFrame) -> DataFrame:
    """One row: nodes, components, largest, satellites (2 or more nodes, the largest excluded), isolates, connected (%)."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    out = sizes.agg(F.sum("size").alias("nodes"), F.count("*").alias("components"), F.max("size").alias("largest"), (F.count_if(F.col("size") > 1) - F.when(F.max("size") > 1, 1).otherwise(0)).alias("satellites"), F.count_if(F.col("size") == 1).alias("isolates"))
    return out.withColumn("connected", F.round(100.0 * (F.col("nodes") - F.col("isolates")) / F.col("nodes"), 1))


def edition(graph: Graph, corpora: list[str], corpus: str = "corpus") -> Graph:
    """The subgraph of some corpora: their edges, and nodes at these or with provenance in them."""
    edges = graph.edges.where(F.col(corpus).isin(*corpora))
    keep = endpoints(edges).distinct()
    if "provenance" in graph.nodes.columns:
        told = graph.nodes.where(F.exists("provenance", lambda p: F.substring_index(p["chapter_path"], " / ", 1).isin(*corpora))).select("id")
        keep = keep.union(told).distinct()
    return Graph(graph.nodes.join(keep, "id", "left_semi"), edges)


def preview(graph: Graph, thresholds: dict[str, int], default: int = 2, k: int = 420) -> Graph:
    """The induced subgraph of the k nodes of highest degree (then id) that reach their class's least degree."""
    least = F.lit(default)
    for cls, n in thresholds.items():
        least = F.when(F.col("cls") == cls, n).otherwise(least)
    best = graph.nodes.join(degree(graph.edges), "id").where(F.col("degree") >= least).orderBy(F.desc("degree"), "id").limit(k)
    best = cut(best.select("id"))
    nodes = graph.nodes.join(F.broadcast(best), "id", "left_semi")
    return Graph(nodes, known_edges(graph.edges, best))


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: q of a partition (id, community) of an undirected weighted graph (a, b, w)."""
    own = lambda end: member.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
    rows = edges.join(own("a"), "a").join(own("b"), "b")
    ends = rows.select(F.col("ca").alias("c"), "w", (F.col("ca") == F.col("cb")).alias("inside")).union(rows.select("cb", "w", F.lit(False)))
    sums = ends.groupBy("c").agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("w"))), F.lit(0)).alias("inside"), F.sum("w").alias("total"))
    m = rows.agg(F.sum("w").alias("m"))
    return sums.crossJoin(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("total") / (2 * F.col("m")), 2)).alias("q"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community by weighted label propagation: each round every node takes the label with the largest weight
    among its neighbours and itself (its own counts as its largest edge), then the smallest. Labels are ids."""
    both = cut(edges.select("a", "b", "w").union(edges.select("b", "a", "w")))
    own = both.groupBy("a").agg(F.max("w").alias("w"))
    label = cut(both.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(label.toDF("b", "community"), "b").select("a", "community", "w").union(own.join(label.toDF("a", "community"), "a").select("a", "community", "w"))
        sums = votes.groupBy("a", "community").agg(F.sum("w").alias("w"))
        new = cut(sums.groupBy("a").agg(F.min_by("community", F.struct((-F.col("w")).alias("w"), "community")).alias("community")).withColumnRenamed("a", "id"))
        changed = new.join(label.toDF("id", "old"), "id").where("community <> old").isEmpty()
        label = new
        if changed:
            break
    return label


def ring(nodes: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Places on a sunflower spiral for nodes ranked by id: closed form from the rank, for isolates."""
    ranked = numbered(nodes.select("id"), [F.asc("id")], "k")
    angle = F.col("k") * F.lit(2.399963229728653)
    radius = F.lit(spacing) * F.sqrt(F.col("k") + 0.5)
    return ranked.select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def centre(places: DataFrame) -> DataFrame:
    return places.agg(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("y") + F.max("y")) / 2).alias("y"))


