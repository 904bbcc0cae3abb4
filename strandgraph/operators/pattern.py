"""Graph patterns as joins: one hop, chains, optional and negated parts, pairs, top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph


def with_node(rows: DataFrame, nodes: DataFrame, key: str, prefix: str, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """rows with columns of the node whose id is in key, as <prefix>_<column>; rows without one go."""
    own = nodes.select(F.col("id").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return rows.join(own, key)


def hop(graph: Graph, types: tuple[str, ...], s: str = "s", o: str = "o", columns: tuple[str, ...] = ("name",), subjects: DataFrame | None = None, objects: DataFrame | None = None) -> DataFrame:
    """Edges of the types with both end nodes: s, o (ids), s_<column>, o_<column>, type and n_support.

    subjects and objects are nodes to match at either end (default: all). Columns of a
    chain's later hop get other names by other s and o.
    """
    edges = graph.typed(*types).select(F.col("subject_id").alias(s), F.col("object_id").alias(o), F.col("type").alias(f"{s}_{o}_type"), F.col("n_support").alias(f"{s}_{o}_n"))
    rows = with_node(edges, graph.nodes if subjects is None else subjects, s, s, columns)
    return with_node(rows, graph.nodes if objects is None else objects, o, o, columns)


def optional(rows: DataFrame, pattern: DataFrame, on: str) -> DataFrame:
    """Every row, with the matches of a whole optional pattern or nulls."""
    return rows.join(pattern, on, "left")


def endpoints(edges: DataFrame) -> DataFrame:
    """The id of each end of each edge, with repeats."""
    return edges.select(F.col("subject_id").alias("id")).union(edges.select(F.col("object_id").alias("id")))


def apart(nodes: DataFrame, key: str, *ends: DataFrame) -> DataFrame:
    """Nodes whose key is in none of the ends, tables of one column each; nodes without a key stay.

    Ends are made distinct table by table: the planner then drops a grouping of edges beneath, which a union would keep.
    """
    return nodes.join(reduce(DataFrame.union, [e.toDF(key).distinct() for e in ends]), key, "left_anti")


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no edge."""
    return apart(nodes, "id", edges.select("subject_id"), edges.select("object_id"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi").select(edges.columns)


def degree(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """id, degree (a self-loop counts twice) and, with a weight, strength."""
    w = F.col(weight) if weight else F.lit(1)
    ends = edges.select(F.col("subject_id").alias("id"), w.alias("w")).union(edges.select(F.col("object_id").alias("id"), w.alias("w")))
    sums = [F.count("*").alias("degree")] + ([F.sum("w").alias("strength")] if weight else [])
    return ends.groupBy("id").agg(*sums)


def pairs_within(members: DataFrame, group: str, item: str) -> DataFrame:
    """a < b of each group: the distinct items of a group are joined with themselves by the group.

    For baskets: the rows grow with the square of a group's items, so groups must be small by nature.
    """
    m = members.select(group, item).distinct()
    return m.select(group, F.col(item).alias("a")).join(m.select(group, F.col(item).alias("b")), group).where("a < b")


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; order must be total for a defined result."""
    return rows.orderBy(*order).limit(k)


def top_per_group(rows: DataFrame, k: int, group: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def first_items(item: str, k: int | None = None) -> Column:
    """The distinct non-null items of a group in order, at most k."""
    every = F.sort_array(F.collect_set(item))
    return every if k is None else F.slice(every, 1, k)


def counted_with_first(rows: DataFrame, group: str, item: str, k: int, name: str) -> DataFrame:
    """group, n (rows) and the first k distinct non-null items of a group in order.

    Items are counted before they are ranked, so no buffer grows with a group's items; the counts are kept, as both sides read them.
    """
    from .graph import cut  # which reads patterns itself

    counts = cut(rows.groupBy(group, item).agg(F.count("*").alias("n")))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_last(item)))
    first = counts.where(F.col(item).isNotNull()).select(group, item, rank.alias("rank")).where(F.col("rank") <= k)
    named = first.groupBy(F.col(group).alias("__g")).agg(F.sort_array(F.collect_list(item)).alias(name))
    total = counts.groupBy(group).agg(F.sum("n").alias("n"))
    return total.join(named, F.col(group).eqNullSafe(F.col("__g")), "left").select(group, "n", F.coalesce(name, F.array().cast(named.schema[name].dataType)).alias(name))


def neighbourhood(graph: Graph, node_id: str) -> DataFrame:
    """Edges at a node, with direction and the other end."""
    e = graph.edges
    return e.where(F.col("subject_id") == node_id).select("type", F.lit("out").alias("direction"), F.col("object_id").alias("other")).union(
        e.where(F.col("object_id") == node_id).select("type", F.lit("in"), "subject_id")
    )


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name, an alias or an attribute holds the text, letter case aside."""
    low = text.lower()
    hit = F.lower("name").contains(low)
    if "aliases" in nodes.columns:
        hit = hit | F.exists("aliases", lambda a: F.lower(a).contains(low))
    if "attrs" in nodes.columns:
        hit = hit | F.exists(F.map_values("attrs"), lambda a: F.lower(a).contains(low))
    return nodes.where(hit)


def case_list(records: DataFrame, diagnosis: str | None = None, year: int | None = None, q: str | None = None) -> DataFrame:
    """Case records with an array `diagnoses`, a `year` and a `title`: those with a diagnosis, of a year, whose title or a diagnosis holds q; None filters nothing."""
    if diagnosis is not None:
        records = records.where(F.array_contains("diagnoses", diagnosis))
    if year is not None:
        records = records.where(F.col("year") == year)
    if q is not None:
        records = records.where(F.lower("title").contains(q.lower()) | F.exists("diagnoses", lambda x: F.lower(x).contains(q.lower())))
    return records


def filter_edges(edges: DataFrame, **equal: str | None) -> DataFrame:
    """Edges by any of layer, corpus, type and so on; None filters nothing."""
    for name, value in equal.items():
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges
