"""Queries over files that are written first: a merged release, Turtle read back, an index searched; and strings of JSON without a schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.privacy import json_leaves
from ..model import Graph
from ..operators.graph import cut, delete, shared_folder
from ..operators.search import search, write_index
from ..operators.triples import turtle_lines, triples
from ..sources.delivery import merge_rows
from ..sources.testdata import star_graph, table
from ..sources.turtle import read_triples
from .registry import query


def written_then(spark: SparkSession, use) -> DataFrame:
    """What `use` makes with a folder of the shared one, cut from the folder, which goes."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    out = cut(use(folder))
    delete(spark, folder)
    return out


@query("s13_merged_release", """
WITH d AS (SELECT c_custkey, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < -500) GROUP BY 1)
SELECT 'customer:' || c.c_custkey AS id, CASE WHEN n = 2 THEN 'far below' WHEN n = 1 THEN 'below' ELSE c_mktsegment END AS cls, c_name AS name, 1::BIGINT AS rows FROM customer c LEFT JOIN d USING (c_custkey)""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Customers by segment, then a delivery that moves those in debt to other folders, twice for some; each key once."""
    t = table(spark, d, "customer")
    row = lambda cls: (F.concat(F.lit("customer:"), "c_custkey").alias("id"), cls.alias("cls"), F.col("c_name").alias("name"))
    delivery = t.where("c_acctbal < 0").select(*row(F.lit("below")), F.lit(1).alias("seq")).union(t.where("c_acctbal < -500").select(*row(F.lit("far below")), F.lit(2)))

    def use(folder: str) -> DataFrame:
        merge_rows(spark, folder, t.select(*row(F.col("c_mktsegment"))), ["id"], "cls")
        merge_rows(spark, folder, delivery, ["id"], "cls", "seq")
        return spark.read.parquet(folder).groupBy("id").agg(F.max("cls").alias("cls"), F.max("name").alias("name"), F.count("*").alias("rows"))

    return written_then(spark, use)


@query("s17_turtle_read", """
SELECT 'nation:' || n_nationkey AS s, 'name' AS p, n_name AS o, 'literal' AS kind, 'en' AS lang FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'a', 'nation', 'iri', NULL FROM nation
UNION ALL SELECT 'nation:' || n_nationkey, 'n_regionkey', n_regionkey::VARCHAR, 'literal', 'en' FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'nationInRegion', 'region:' || n_regionkey, 'iri', NULL FROM nation
UNION ALL SELECT 'region:' || r_regionkey, 'name', r_name, 'literal', 'en' FROM region UNION ALL SELECT 'region:' || r_regionkey, 'a', 'region', 'iri', NULL FROM region
UNION ALL SELECT 'supplier:' || s_suppkey, 'name', s_name, 'literal', 'en' FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey, 'a', 'supplier', 'iri', NULL FROM supplier
UNION ALL SELECT 'supplier:' || s_suppkey, 's_nationkey', s_nationkey::VARCHAR, 'literal', 'en' FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey, 'supplierInNation', 'nation:' || s_nationkey, 'iri', NULL FROM supplier""")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """The triples of regions, nations and suppliers, written as Turtle and read back. Balances stay out: their digits are the engine's."""
    graph = star_graph(spark, d)
    nodes = graph.of("region", "nation", "supplier").withColumn("attrs", F.map_filter("attrs", lambda k, v: k != "s_acctbal"))
    told = triples(Graph(nodes, graph.typed("nationInRegion", "supplierInNation")))

    def use(folder: str) -> DataFrame:
        turtle_lines(told).write.text(folder)
        return read_triples(spark, folder)

    return written_then(spark, use)


@query("n01_indexed_search", """
SELECT 'part:' || p_partkey AS id FROM part WHERE contains(lower(p_name), 'd#2') OR contains(lower(p_brand), 'd#2') OR contains(lower(p_type), 'd#2') OR contains(p_size::VARCHAR, 'd#2')
UNION SELECT 'supplier:' || s_suppkey FROM supplier WHERE contains(lower(s_name), 'd#2')""")
def n01(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers with a value that holds "D#2", from the index of all their values."""

    def use(folder: str) -> DataFrame:
        write_index(star_graph(spark, d).of("part", "supplier"), folder)
        return search(spark, folder, "D#2")

    return written_then(spark, use)


@query("x30_json_leaves", """
WITH e AS (SELECT event_id AS id, event_type AS t, user_id AS u, event_id % 3 AS k FROM events)
SELECT id, '$.kind' AS path, t AS text FROM e UNION ALL SELECT id, '$.who[1].name', 'u' || u FROM e WHERE k = 0 UNION ALL SELECT id, '$.who[1].more[0][0]', t FROM e WHERE k = 0
UNION ALL SELECT id, '$.note', 'n' || u FROM e WHERE k = 1""")
def x30(spark: SparkSession, d: str) -> DataFrame:
    """The strings of JSON made of events, nested and of other fields by row."""
    who = F.concat(F.lit('[null, {"name": "u'), "user_id", F.lit('", "id": "secret", "more": [["'), "event_type", F.lit('", "", 1.5]]}]'))
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "who": '), who)).when(F.col("event_id") % 3 == 1, F.concat(F.lit(', "note": "n'), "user_id", F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"id": "x", "kind": "'), "event_type", F.lit('", "props": '), "props", body, F.lit("}"))
    return json_leaves(table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("j")), "id", "j")
