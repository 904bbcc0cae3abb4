"""The star schema as a property graph: keys become ids "<kind>:<key>", other columns attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph

#: kind, table, key, name
NODES = [
    ("region", "region", "r_regionkey", "r_name"),
    ("nation", "nation", "n_nationkey", "n_name"),
    ("customer", "customer", "c_custkey", "c_name"),
    ("supplier", "supplier", "s_suppkey", "s_name"),
    ("part", "part", "p_partkey", "p_name"),
    ("order", "orders", "o_orderkey", "o_orderkey"),
]
#: type, table, subject kind and key, object kind and key, layer, declared cardinality
EDGES = [
    ("nationInRegion", "nation", "nation", "n_nationkey", "region", "n_regionkey", "geo", "0..1"),
    ("customerInNation", "customer", "customer", "c_custkey", "nation", "c_nationkey", "geo", "0..1"),
    ("supplierInNation", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "geo", "0..1"),
    ("orderByCustomer", "orders", "order", "o_orderkey", "customer", "o_custkey", "commerce", "0..1"),
    ("orderHasPart", "lineitem", "order", "l_orderkey", "part", "l_partkey", "commerce", "0..*"),
    ("partFromSupplier", "lineitem", "part", "l_partkey", "supplier", "l_suppkey", "supply", "0..1"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A filter on cls or type leaves only the branches of that class or type in the plan."""
    nodes = edges = None
    parts = {}
    for kind, name, key, label in NODES:
        t = table(spark, sf_dir, name)
        attrs = [x for c in t.columns if c not in (key, label) for x in (F.lit(c), F.col(c).cast("string"))]
        own = t.select(
            node_id(kind, key).alias("id"), F.lit(kind).alias("cls"), F.col(label).cast("string").alias("name"),
            (F.create_map(*attrs) if attrs else F.expr("cast(map() as map<string,string>)")).alias("attrs"),
        )
        nodes = own if nodes is None else nodes.union(own)
    for type_, name, subject, s_key, object_, o_key, layer, _ in EDGES:
        t = table(spark, sf_dir, name)
        pairs = t.select(F.col(s_key).alias("s"), F.col(o_key).alias("o"))
        # Lines of one order and part, or part and supplier, are one edge with their number as support.
        pairs = pairs.groupBy("s", "o").agg(F.count("*").alias("n_support")) if name == "lineitem" else pairs.withColumn("n_support", F.lit(1).cast("long"))
        own = pairs.select(
            F.lit(type_).alias("type"), node_id(subject, "s").alias("subject_id"), node_id(object_, "o").alias("object_id"),
            "n_support", F.lit(layer).alias("layer"),
        )
        parts[type_] = own
        edges = own if edges is None else edges.union(own)
    return Graph(nodes, edges, once=True, parts=parts)


def kinds(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, list[DataFrame]]]:
    """For each kind its nodes (cls, key) and the keys at the ends of all edges, by column: joins on keys are cheaper than on ids."""
    columns = dict.fromkeys(x for _, name, subject, s, object_, o, *_ in EDGES for x in ((subject, name, s), (object_, name, o)))
    ends = lambda kind: [table(spark, sf_dir, name).select(key) for at, name, key in columns if at == kind]
    return [(table(spark, sf_dir, name).select(F.lit(kind).alias("cls"), F.col(key).alias("key")), ends(kind)) for kind, name, key, _ in NODES]


def star_ontology(spark: SparkSession) -> DataFrame:
    """type, domain, range, card: a row for each declared relation."""
    return spark.createDataFrame([(e[0], e[2], e[4], e[7]) for e in EDGES], "type string, domain string, range string, card string")


def nodes_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{k}:' || {key} AS id, '{k}' AS cls, {label}::VARCHAR AS name FROM {t}" for k, t, key, label in NODES)


def edges_sql() -> str:
    parts = []
    for type_, t, s, sk, o, ok, layer, _ in EDGES:
        grouped = t == "lineitem"
        parts.append(
            f"SELECT '{type_}' AS type, '{s}:' || {sk} AS s, '{o}:' || {ok} AS o, {'count(*)' if grouped else '1::BIGINT'} AS n_support, '{layer}' AS layer FROM {t}"
            + (f" GROUP BY {sk}, {ok}" if grouped else "")
        )
    return " UNION ALL ".join(parts)


def ontology_sql() -> str:
    return "VALUES " + ", ".join(f"('{e[0]}', '{e[2]}', '{e[4]}', '{e[7]}')" for e in EDGES)
