"""Readers of graph deliveries: JSON, JSON inside HTML, typed CSV, corpora, ontology, layout and profiles.

All take paths or globs that Spark opens. Line-delimited JSON is split between tasks; one
document that holds a whole graph is read by one task, as the format has it, and exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EDGE_SCHEMA, NODE_SCHEMA, Graph, filled

#: What a delivery's edges may carry; columns that it lacks are null.
NODE_FIELDS = "id string, cls string, name string, aliases array<string>, attrs map<string,string>, x double, y double"


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """A document {nodes: [...], edges: [...]}."""
    doc = spark.read.schema(f"nodes array<struct<{NODE_SCHEMA}>>, edges array<struct<{EDGE_SCHEMA}>>").json(path, multiLine=True)
    return Graph(doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("edges").alias("e")).select("e.*"))


def read_graph_lines(spark: SparkSession, nodes: str, edges: str) -> Graph:
    """Nodes and edges as JSON Lines, as the writer leaves them."""
    return Graph(spark.read.schema(NODE_SCHEMA).json(nodes), spark.read.schema(EDGE_SCHEMA).json(edges))


def script_of(html: Column, kind: str | None = None) -> Column:
    """The text of the first <script>, or of the first of a type; empty without one."""
    of = "" if kind is None else rf"""\btype\s*=\s*["']?{kind}["']?[^>]*"""
    return F.coalesce(F.regexp_extract(html, rf"(?is)<script[^>]*{of}>(.*?)</script>", 1), F.lit(""))


def read_embedded_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON of each file: the file itself, or its first <script type=application/json>."""
    texts = spark.read.text(path, wholetext=True)
    inner = script_of(F.col("value"), "application/json")
    return texts.select(F.from_json(F.coalesce(filled(inner), "value"), schema).alias("j")).select("j.*")


def with_layout(nodes: DataFrame, layout: DataFrame) -> DataFrame:
    """nodes with x and y of the layout (id, x, y) where it has them."""
    at = layout.select("id", F.col("x").alias("__x"), F.col("y").alias("__y"))
    out = nodes.join(at, "id", "left").withColumns({"x": F.coalesce("__x", "x"), "y": F.coalesce("__y", "y")})
    return out.select(nodes.columns)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y from a document {id: [x, y]}."""
    texts = spark.read.text(path, wholetext=True)
    places = texts.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("id", "p"))
    return places.select("id", F.get("p", 0).alias("x"), F.get("p", 1).alias("y"))


def read_previous(spark: SparkSession, path: str, skip_engine: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and (subject_id, object_id, type, engine) of an earlier release, edges of one engine left out; empty without the file."""
    if not exists(spark, path):
        return spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], "subject_id string, object_id string, type string, engine string")
    g = read_graph_json(spark, path)
    engines = g.edges.where("engine is not null and engine <> ''").where(F.col("engine") != skip_engine)
    return g.nodes, engines.select("subject_id", "object_id", "type", "engine")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns, quotes doubled, line breaks in quotes allowed, a byte-order mark ignored."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1)
    return rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])


def read_nodes_csv(spark: SparkSession, path: str) -> DataFrame:
    """id and attrs: typed headers name:type lose the type; columns that start with : and name, aliases and n_mentions are no attributes; empty cells go."""
    rows = _csv(spark, path)
    attrs = {c: c.split(":")[0] for c in rows.columns if not c.startswith(":")}
    attrs = {c: n for c, n in attrs.items() if n not in ("name", "aliases", "n_mentions")}
    pairs = [x for c, n in attrs.items() for x in (F.lit(n), F.col(f"`{c}`"))]
    values = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return rows.select(F.col("`:ID`").alias("id"), F.map_filter(values, lambda k, v: v.isNotNull() & (v != "")).alias("attrs"))


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edges with their place among rows of the same subject, object and type, by the order of the file.

    A file with line breaks in quotes is read by one task, whose row numbers keep the order.
    """
    rows = _csv(spark, path)
    named = rows.select(*[F.col(f"`{c}`").alias({":START_ID": "subject_id", ":END_ID": "object_id", ":TYPE": "type"}.get(c, c.split(":")[0])) for c in rows.columns])
    order = Window.partitionBy("subject_id", "object_id", "type").orderBy("__row")
    return named.withColumn("__row", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(order)).drop("__row")


def read_passages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """pid, source, text, n_chars of {passages: [...]} documents; pid or id; a later file wins; missing files are skipped."""
    schema = "passages array<struct<pid string, id string, source string, text string>>"
    out = None
    for place, path in enumerate(p for p in paths if exists(spark, p)):
        rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("passages").alias("p"))
        own = rows.select(F.coalesce("p.pid", "p.id").alias("pid"), "p.source", "p.text", F.lit(place).alias("place"))
        out = own if out is None else out.union(own)
    if out is None:
        return spark.createDataFrame([], "pid string, source string, text string, n_chars int")
    last = out.groupBy("pid").agg(F.max_by(F.struct("source", "text"), "place").alias("p"))
    return last.select("pid", "p.source", "p.text", F.length("p.text").alias("n_chars"))


def read_source(spark: SparkSession, path: str, source: str, pids: DataFrame | None = None) -> DataFrame:
    """pid, source, text, n_chars of one source of a corpus that write_corpus wrote, from that source's files alone; pids (pid): only those."""
    rows = spark.read.schema("pid string, text string, n_chars int, source string").parquet(path).where(F.col("source") == source).select("pid", "source", "text", "n_chars")
    return rows if pids is None else rows.join(pids.select("pid").distinct(), "pid", "left_semi")


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cls, attrs, modalities) and (type, domain, range, card, qualifier) of a document {classes: {...}, object_properties: {...}}."""
    doc = spark.read.schema(
        "classes map<string,struct<zh string, attrs array<string>, modalities array<string>>>, "
        "object_properties map<string,struct<zh string, domain string, range string, card string, qualifier array<string>>>"
    ).json(path, multiLine=True)
    classes = doc.select(F.explode("classes").alias("cls", "c")).select("cls", "c.zh", "c.attrs", "c.modalities")
    relations = doc.select(F.explode("object_properties").alias("type", "p")).select("type", "p.zh", "p.domain", "p.range", "p.card", "p.qualifier")
    return classes, relations


def read_profiles(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """Rows of n_cases at least `least`; a file without that column is an error."""
    rows = _csv(spark, path)
    if "n_cases" not in rows.columns:
        raise ValueError(f"{path} has no column n_cases")
    return rows.where(F.col("n_cases").try_cast("int") >= least)


def parse_names(spark: SparkSession, table: str) -> DataFrame:
    """raw, std, note of lines raw>std|note."""
    lines = [x.strip() for x in table.splitlines() if x.strip()]
    return spark.createDataFrame([(*pair.split(">", 1), note) for pair, _, note in (x.partition("|") for x in lines)], "raw string, std string, note string")


def parse_properties(spark: SparkSession, table: str) -> DataFrame:
    """name, qi, wei, gui, tox, cat, sub, src, note of lines with nine fields between |; wei and gui are lists by comma."""
    rows = []
    for line in filter(None, map(str.strip, table.splitlines())):
        f = line.split("|")
        rows.append((f[0], f[1], f[2].split(",") if f[2] else [], f[3].split(",") if f[3] else [], *f[4:9]))
    return spark.createDataFrame(rows, "name string, qi string, wei array<string>, gui array<string>, tox string, cat string, sub string, src string, note string")


def require_size(graph: Graph, nodes: int, edges: int) -> Graph:
    """The graph, if it has the stated numbers of nodes and edges; else an error."""
    found = (graph.nodes.count(), graph.edges.count())
    if found != (nodes, edges):
        raise ValueError(f"expected {nodes} nodes and {edges} edges, found {found[0]} and {found[1]}")
    return graph


def read_csv_graph(spark: SparkSession, nodes: str, edges: str) -> Graph:
    """A graph from its typed CSV tables: ids are unique, edges need both ends and merge on (subject, type, object)."""
    rows = _csv(spark, nodes)
    col = lambda c: F.col(f"`{c}`")
    fixed = {":ID", ":LABEL", "name:string", "aliases:string[]", "n_mentions:int", "n_provenance:int", "x:float", "y:float", "component:int"}
    pairs = [x for c in rows.columns if c not in fixed for x in (F.lit(c.split(":")[0]), col(c))]
    attrs = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    number = lambda c, kind: col(c).try_cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    node_rows = rows.select(
        col(":ID").alias("id"), col(":LABEL").alias("cls"), col("name:string").alias("name"),
        F.filter(F.split(F.coalesce(col("aliases:string[]"), F.lit("")), ";"), lambda a: a != "").alias("aliases"),
        F.map_filter(attrs, lambda k, v: v.isNotNull() & (v != "")).alias("attrs"),
        number("n_mentions:int", "int").alias("n_mentions"), number("n_provenance:int", "int").alias("n_provenance"),
        number("x:float", "double").alias("x"), number("y:float", "double").alias("y"), number("component:int", "int").alias("component"),
    ).dropDuplicates(["id"])
    links = read_edges_csv(spark, edges).drop("place")
    for name, kind in (("n_support", "int"), ("evidence_verbatim", "boolean"), ("evidence_in_passage", "boolean")):
        if name in links.columns:
            links = links.withColumn(name, F.nullif(F.col(name), F.lit("")).cast(kind))
    ids = node_rows.select("id")
    links = links.join(ids.toDF("subject_id"), "subject_id", "left_semi").join(ids.toDF("object_id"), "object_id", "left_semi")
    return Graph(node_rows, links.dropDuplicates(["subject_id", "object_id", "type"]))
