"""Deriving and releasing graph tables: merges with other deliveries, withholding, redaction, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.privacy import redact
from ..model import Graph
from .pattern import endpoints


def merged_attributes(nodes: DataFrame, csv_attrs: DataFrame) -> DataFrame:
    """nodes whose missing attributes come from (id, attrs) of another delivery; their own precede, empty ones go."""
    more = csv_attrs.select("id", F.col("attrs").alias("__more"))
    own = F.map_filter(F.coalesce("attrs", F.expr("cast(map() as map<string,string>)")), lambda k, v: v.isNotNull() & (v != ""))
    both = F.map_zip_with(own, F.coalesce("__more", F.expr("cast(map() as map<string,string>)")), lambda k, a, b: F.coalesce(a, b))
    return nodes.join(more, "id", "left").withColumn("attrs", both).select(nodes.columns)


def resolved_engines(edges: DataFrame, csv_edges: DataFrame, previous: DataFrame, by_layer: DataFrame) -> DataFrame:
    """edges with engine and engine_origin: the CSV row of the same place among equal triples, else the previous
    release's, else the layer's. edges need an ordinal column that orders equal triples; csv_edges a place."""
    key = ["subject_id", "object_id", "type"]
    placed = edges.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("ordinal")))
    csv = csv_edges.select(*key, "place", F.col("engine").alias("__csv"))
    old = previous.groupBy(*key).agg(F.min("engine").alias("__old"))
    layer = by_layer.select("layer", F.col("engine").alias("__layer"))
    rows = placed.drop("engine").join(csv, [*key, "place"], "left").join(old, key, "left").join(F.broadcast(layer), "layer", "left")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    origin = F.when(text("__csv").isNotNull(), "csv").when(text("__old").isNotNull(), "previous").when(text("__layer").isNotNull(), "layer").otherwise("none")
    return rows.withColumn("engine", F.coalesce(text("__csv"), text("__old"), text("__layer"), F.lit(""))).withColumn("engine_origin", origin).drop("__csv", "__old", "__layer", "place")


def engine_modes(edges: DataFrame) -> DataFrame:
    """layer and its most common engine, ties to the one seen first by the edges' ordinal."""
    counts = edges.where("engine <> ''").groupBy("layer", "engine").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("n"), "first"))).where("r = 1").select("layer", "engine")


def with_origin(edges: DataFrame, corpora: dict[str, str], layers: dict[str, str], numbered: str = "", modern: str = "modern") -> DataFrame:
    """edges with corpus and layer derived where they are missing."""
    corpus = F.coalesce(F.nullif(F.col("corpus"), F.lit("")), X.corpus_of(F.col("chapter_path"), corpora, numbered))
    out = edges.withColumn("corpus", corpus)
    return out.withColumn("layer", F.coalesce(F.nullif(F.col("layer"), F.lit("")), X.layer_of(F.col("type"), F.col("corpus"), layers, modern)))


def inferred_ends(graph: Graph, types: DataFrame) -> DataFrame:
    """type, domain, range: the most common classes at the ends of each of the types, ties by name."""
    cls = graph.nodes.select("id", "cls")
    rows = graph.edges.join(types.select("type"), "type", "left_semi").join(cls.toDF("subject_id", "domain"), "subject_id").join(cls.toDF("object_id", "range"), "object_id")
    counts = rows.groupBy("type", "domain", "range").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "domain", "range"))).where("r = 1").select("type", "domain", "range")


def undeclared_attributes(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, attr in use that the ontology (cls, attrs) doesn't declare."""
    used = nodes.select("cls", F.explode(F.map_keys("attrs")).alias("attr")).distinct()
    return used.join(classes.select("cls", F.explode("attrs").alias("attr")), ["cls", "attr"], "left_anti")


def withhold(graph: Graph, corpus: str, previous_nodes: DataFrame) -> Graph:
    """The graph without a corpus: its edges go, and nodes that only it introduced; other nodes lose their provenance in
    it, and get back the name and coordinates of the previous release where that has them."""
    edges = graph.edges.where(F.coalesce(F.col("corpus") != corpus, F.lit(True)))
    nodes = graph.nodes.withColumn("provenance", F.filter("provenance", lambda p: X.root_of(p["chapter_path"]) != corpus))
    at_edge = endpoints(edges).distinct().withColumn("__edge", F.lit(True))
    old = previous_nodes.select("id", F.col("name").alias("__name"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    rows = nodes.join(at_edge, "id", "left").join(old, "id", "left")
    keep = F.col("__edge").isNotNull() | F.col("__name").isNotNull() | (F.size("provenance") > 0)
    out = rows.where(keep).withColumns({"name": F.coalesce("__name", "name"), "x": F.coalesce("__x", "x"), "y": F.coalesce("__y", "y")})
    return Graph(out.select(graph.nodes.columns), edges)


def redacted_edges(edges: DataFrame, corpus: str) -> DataFrame:
    """edges with the sentences of one corpus redacted, and hits (null for others)."""
    done = redact(edges.where(F.col("corpus") == corpus), "source_sentence")
    rest = edges.where(F.coalesce(F.col("corpus") != corpus, F.lit(True)))
    return rest.withColumn("hits", F.lit(None).cast("map<string,int>")).unionByName(done.withColumn("hits", F.col("hits").cast("map<string,int>")))


def published_corpus(passages: DataFrame, corpus: str | None) -> DataFrame:
    """passages fit to publish: of the named corpus the text is redacted, the visit dates become their span in days and the
    age is capped; lengths are counted anew. None leaves that corpus out."""
    own = passages.where(F.col("source") == corpus) if corpus else passages.limit(0)
    done = redact(own, "text").drop("hits")
    if "visit_dates" in passages.columns:
        done = done.withColumn("visit_span_days", X.span_days(F.col("visit_dates"))).drop("visit_dates")
    if "age" in passages.columns:
        done = done.withColumn("age", X.capped_age(F.col("age")))
    rest = passages.where(F.coalesce(F.col("source") != corpus, F.lit(True))) if corpus else passages
    return rest.drop("visit_dates").unionByName(done, allowMissingColumns=True).withColumn("n_chars", F.length("text"))


def new_nodes(nodes: DataFrame, public: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that a public release has, and those that it hasn't."""
    ids = public.select("id").distinct()
    return nodes.join(ids, "id", "left_semi"), nodes.join(ids, "id", "left_anti")


def case_records(graph: Graph, types: list[str], kind: str = "CaseRecord") -> DataFrame:
    """id and an array of distinct object names for each relation type, in the order of the edges' ordinal."""
    cases = graph.nodes.where(F.col("cls") == kind).select(F.col("id").alias("subject_id"))
    named = graph.edges.where(F.col("type").isin(*types)).join(graph.nodes.select(F.col("id").alias("object_id"), "name"), "object_id")
    # Dealt by case first: every group is then whole in its task, and no buffer of a part of one is shuffled.
    rows = named.select("subject_id", "type", "ordinal", "name").repartition("subject_id").groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("type", "ordinal", "name"))).alias("all"))
    of = lambda t: F.array_distinct(F.transform(F.filter("all", lambda x: x["type"] == t), lambda x: x["name"]))
    none = F.array().cast("array<string>")
    return cases.join(rows, "subject_id", "left").select(F.col("subject_id").alias("id"), *[F.coalesce(of(t), none).alias(t) for t in types])
