"""Queries over the derivations of a release: engines, attributes, origins, inferred ends, case records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import Graph, attr
from ..operators import graph as G
from ..operators import release as R
from ..operators.triples import literal
from ..sources.testdata import edges_sql, node_id, nodes_sql, star_graph, table
from .registry import query


@query("p04_merged_attributes", """
SELECT 'customer:' || c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'paid' END AS balance, c_nationkey::VARCHAR AS nation FROM customer""")
def p04(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("id", node_id("customer", "c_custkey"))
    own = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("balance"), F.when(F.col("c_acctbal") < 0, "").otherwise("paid"))
    more = F.create_map(F.lit("segment"), F.lit("unused"), F.lit("balance"), F.lit("debt"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    merged = R.merged_attributes(rows.select("id", own.alias("attrs")), rows.select("id", more.alias("attrs")))
    return merged.select("id", *[attr(a).alias(a) for a in ("segment", "balance", "nation")])


@query("p07_resolved_engines", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS place FROM lineitem)
SELECT l_orderkey::VARCHAR AS subject_id, l_partkey::VARCHAR AS object_id, l_linenumber AS line, l_quantity AS quantity,
  CASE WHEN place = 1 AND l_quantity > 25 THEN l_linestatus WHEN l_partkey % 2 = 0 THEN 'earlier' WHEN l_returnflag = 'R' THEN 'model-r' WHEN l_returnflag = 'A' THEN 'model-a' ELSE '' END AS engine,
  CASE WHEN place = 1 AND l_quantity > 25 THEN 'csv' WHEN l_partkey % 2 = 0 THEN 'previous' WHEN l_returnflag IN ('R', 'A') THEN 'layer' ELSE 'none' END AS engine_origin FROM l""")
def p07(spark: SparkSession, d: str) -> DataFrame:
    key = ["subject_id", "object_id", "type"]
    edges = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("subject_id"), F.col("l_partkey").cast("string").alias("object_id"), F.lit("orderHasPart").alias("type"),
        F.struct("l_linenumber", "l_quantity", "l_extendedprice").alias("ordinal"), F.col("l_returnflag").alias("layer"), F.lit(None).cast("string").alias("engine"), "l_linestatus", "l_quantity", "l_partkey",
    )
    first = edges.groupBy(*key).agg(F.min_by(F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).otherwise(""), "ordinal").alias("engine"))
    previous = edges.where("l_partkey % 2 = 0").select(*key, F.lit("earlier").alias("engine")).distinct()
    by_layer = spark.createDataFrame([("R", "model-r"), ("A", "model-a")], "layer string, engine string")
    done = R.resolved_engines(edges.drop("l_linestatus", "l_quantity", "l_partkey"), first.withColumn("place", F.lit(1)), previous, by_layer)
    return done.select("subject_id", "object_id", F.col("ordinal.l_linenumber").alias("line"), F.col("ordinal.l_quantity").alias("quantity"), "engine", "engine_origin")


@query("p02_derived_origin", """
WITH o AS (SELECT o_orderkey, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'modern' ELSE '' END AS corpus FROM orders)
SELECT o_orderkey AS id, corpus, CASE WHEN corpus = 'modern' THEN 'modern_case' WHEN o_orderstatus = 'F' THEN 'final' ELSE 'lineage' END AS layer FROM o""")
def p02(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.concat_ws(" / ", "o_orderpriority", "o_orderkey").alias("chapter_path"),
        F.lit(None).cast("string").alias("corpus"), F.lit("").alias("layer"),
    )
    return R.with_origin(edges, {"1-URGENT": "urgent", "2-HIGH": "modern"}, {"F": "final"}).select("id", "corpus", "layer")


@query("p11_inferred_ends", f"""
WITH n AS ({nodes_sql()}), e AS ({edges_sql()}),
c AS (SELECT layer AS type, a.cls AS domain, b.cls AS range, count(*) AS k FROM e JOIN n a ON a.id = s JOIN n b ON b.id = o GROUP BY 1, 2, 3)
SELECT type, domain, range FROM c QUALIFY row_number() OVER (PARTITION BY type ORDER BY k DESC, domain, range) = 1""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    graph = star_graph(spark, d)
    layers = graph.edges.withColumn("type", F.col("layer"))
    return R.inferred_ends(Graph(graph.nodes, layers), layers.select("type").distinct())


@query("p12_case_records", """
WITH x AS (SELECT l_orderkey AS k, p_name AS name, min(l_linenumber) AS first_line FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), p AS (SELECT k, list(name ORDER BY first_line, name) AS names FROM x GROUP BY k),
y AS (SELECT l_orderkey AS k, s_name AS name, min(l_linenumber) AS first_line FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), s AS (SELECT k, list(name ORDER BY first_line, name) AS names FROM y GROUP BY k)
SELECT 'order:' || o_orderkey AS id, CASE WHEN c_name IS NULL THEN [] ELSE [c_name] END AS "orderByCustomer", coalesce(p.names, []) AS "orderHasPart", coalesce(s.names, []) AS "orderFromSupplier"
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN p ON p.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey""")
def p12(spark: SparkSession, d: str) -> DataFrame:
    """Names in the order of an order's lines."""
    graph, lines = star_graph(spark, d), table(spark, d, "lineitem")
    one = graph.typed("orderByCustomer").select("subject_id", "object_id", "type", F.lit(0).alias("ordinal"))
    link = lambda kind, key, name: lines.select(node_id("order", "l_orderkey").alias("subject_id"), node_id(kind, key).alias("object_id"), F.lit(name).alias("type"), F.col("l_linenumber").alias("ordinal"))
    edges = one.union(link("part", "l_partkey", "orderHasPart")).union(link("supplier", "l_suppkey", "orderFromSupplier"))
    return R.case_records(Graph(graph.nodes, edges), ["orderByCustomer", "orderHasPart", "orderFromSupplier"], "order")


@query("p08_origins_of_chapters", """
SELECT doc_id, CASE source WHEN 'src1' THEN 'alpha' WHEN 'src2' THEN 'beta' ELSE '' END AS corpus, CASE WHEN source = 'src2' THEN 'modern_case' WHEN lang = 'en' THEN 'own' ELSE 'lineage' END AS layer FROM documents""")
def p08(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "documents").select(
        "doc_id", F.concat("source", F.lit(" / "), "lang").alias("chapter_path"), F.col("lang").alias("type"), F.lit(None).cast("string").alias("corpus"), F.lit("").alias("layer")
    )
    return R.with_origin(told, {"src1": "alpha", "src2": "beta"}, {"en": "own"}, modern="beta").select("doc_id", "corpus", "layer")


@query("p10_undeclared_attributes", """
SELECT 'part' AS cls, unnest(['p_size', 'p_type', 'p_retailprice']) AS attr WHERE EXISTS (FROM part) UNION ALL SELECT 'nation', 'n_regionkey' WHERE EXISTS (FROM nation)
UNION ALL SELECT 'order', unnest(['o_custkey', 'o_orderstatus', 'o_orderdate']) WHERE EXISTS (FROM orders)""")
def p10(spark: SparkSession, d: str) -> DataFrame:
    declared = [("part", ["p_brand", "p_color"]), ("order", ["o_totalprice", "o_orderpriority"]), ("customer", ["c_nationkey", "c_acctbal", "c_mktsegment"]), ("supplier", ["s_nationkey", "s_acctbal"])]
    return R.undeclared_attributes(star_graph(spark, d).nodes, spark.createDataFrame(declared, "cls string, attrs array<string>"))


@query("g07_ring_of_isolates", """
SELECT 'region:' || r_regionkey AS id, round(10 * sqrt(k + 0.5) * cos(k * 2.399963229728653), 6) AS x, round(10 * sqrt(k + 0.5) * sin(k * 2.399963229728653), 6) AS y
FROM (SELECT r_regionkey, row_number() OVER (ORDER BY 'region:' || r_regionkey) - 1 AS k FROM region)
UNION ALL SELECT 'nation:' || n_nationkey, round(sqrt(k + 0.5) * cos(k * 2.399963229728653), 6), round(sqrt(k + 0.5) * sin(k * 2.399963229728653), 6)
FROM (SELECT n_nationkey, row_number() OVER (ORDER BY 'nation:' || n_nationkey) - 1 AS k FROM nation)""")
def g07(spark: SparkSession, d: str) -> DataFrame:
    graph = star_graph(spark, d)
    both = G.ring(graph.of("region"), 10).union(G.ring(graph.of("nation")))
    return both.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("g08_centre", "SELECT (min(l_quantity) + max(l_quantity)) / 2 AS x, (min(l_discount) + max(l_discount)) / 2 AS y FROM lineitem")
def g08(spark: SparkSession, d: str) -> DataFrame:
    return G.centre(table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")))


@query("x03_escaped_literals", """
SELECT item_id, regexp_replace(replace(replace(text || '"\\' || chr(10) || 'x', '\\', '\\\\'), '"', '\\"'), '[\r\n]+', ' ', 'g') AS value FROM benchmark""")
def x03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", literal(F.concat("text", F.lit('"\\\nx'))).alias("value"))


@query("x17_flavours", "SELECT p_partkey, regexp_replace(CASE WHEN p_size % 2 = 0 THEN '微' ELSE '' END || p_type || '微', '^微', '') AS flavour FROM part")
def x17(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.when(F.col("p_size") % 2 == 0, "微").otherwise(""), "p_type", F.lit("微"))
    return table(spark, d, "part").select("p_partkey", X.flavour_base(raw).alias("flavour"))


@query("x10_usage_flags", """
WITH x AS (SELECT p_partkey, 'ab' || CASE WHEN p_size % 3 = 0 THEN '鲜' ELSE '' END || repeat('.', p_size % 4) || p_name || CASE WHEN p_size % 2 = 0 THEN '先用' ELSE '拌' END AS s, p_name AS n, p_size AS z FROM part)
SELECT p_partkey, z % 3 = 0 AND z % 4 < 3 AS fresh, z % 2 = 0 AS decocted, z % 2 = 1 AS mixed FROM x""")
def x10(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    sentence = F.concat(F.lit("ab"), F.when(size % 3 == 0, "鲜").otherwise(""), F.repeat(F.lit("."), size % 4), "p_name", F.when(size % 2 == 0, "先用").otherwise("拌"))
    return table(spark, d, "part").select("p_partkey", X.usage_flags(sentence, F.col("p_name")).alias("f")).select("p_partkey", "f.*")


@query("j25_new_and_public_nodes", """
SELECT 'part:' || p_partkey AS id, p_size > 25 AS is_new FROM part""")
def j25(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("id", node_id("part", "p_partkey"))
    public, new = R.new_nodes(parts.select("id"), parts.where("p_size <= 25"))
    return public.withColumn("is_new", F.lit(False)).union(new.withColumn("is_new", F.lit(True)))
