"""The declarative query catalogue over the star graph, each with the same question in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import attr
from ..operators import pattern as P
from ..operators.phrases import quoted
from ..operators.triples import statements, triples
from ..sources.testdata import edges_sql, kinds, nodes_sql, star_graph, table
from .registry import query

desc, asc = F.desc, F.asc


@query("q01_links_to_nations", """
SELECT 'customerInNation' AS type, c_name AS who, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplierInNation', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q01(spark: SparkSession, d: str) -> DataFrame:
    h = P.hop(star_graph(spark, d), ("customerInNation", "supplierInNation"))
    return h.select(F.col("s_o_type").alias("type"), F.col("s_name").alias("who"), F.col("o_name").alias("nation"))


@query("q02_keyword_statements", """
SELECT source, doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'token')""")
def q02(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.contains("license") | t.contains("token")).select("source", "doc_id")


@query("q03_orders_of_one_customer", """
SELECT o_orderstatus AS status, 'order:' || o_orderkey AS order_id FROM orders WHERE o_custkey = 7""")
def q03(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    one = g.of("customer").where(F.col("id") == "customer:7")
    h = P.hop(g, ("orderByCustomer",), columns=("attrs",), subjects=g.of("order"), objects=one)
    return h.select(attr("o_orderstatus", "s_attrs").alias("status"), F.col("s").alias("order_id"))


@query("q04_everyone_linked_to_a_part", """
SELECT 'orderHasPart' AS type, 'order:' || l_orderkey AS who, p_name AS part FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(p_name, 'ring') GROUP BY l_orderkey, l_partkey, p_name""")
def q04(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    parts = g.of("part").where(F.col("name").contains("ring"))
    e = g.edges.select("type", F.col("subject_id").alias("who"), F.col("object_id").alias("o"))
    return P.with_node(e, parts, "o", "o").select("type", "who", F.col("o_name").alias("part"))


@query("q05_best_supported_edges", """
SELECT 'order:' || l_orderkey AS order_id, 'part:' || l_partkey AS part_id, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey ORDER BY n DESC, order_id, part_id LIMIT 20""")
def q05(spark: SparkSession, d: str) -> DataFrame:
    e = star_graph(spark, d).typed("orderHasPart").select(F.col("subject_id").alias("order_id"), F.col("object_id").alias("part_id"), F.col("n_support").alias("n"))
    return P.top(e, 20, desc("n"), asc("order_id"), asc("part_id"))


@query("q06_false_flag_audit", "SELECT doc_id FROM labels WHERE quality = 0")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("quality = 0").select("doc_id")


@query("q07_attribute_to_targets", """
SELECT p_name AS part, s_name AS supplier, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE p_size = 7 GROUP BY p_partkey, p_name, s_suppkey, s_name ORDER BY n DESC, part, supplier LIMIT 40""")
def q07(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    h = P.hop(g, ("partFromSupplier",), subjects=g.of("part").where(attr("p_size") == "7"), objects=g.of("supplier"))
    rows = h.select(F.col("s_name").alias("part"), F.col("o_name").alias("supplier"), F.col("s_o_n").alias("n"))
    return P.top(rows, 40, desc("n"), asc("part"), asc("supplier"))


@query("q08_inventory_with_optional_targets", """
SELECT p_name AS part, count(DISTINCT s_name) AS n, coalesce(list_sort(list(DISTINCT s_name) FILTER (s_name IS NOT NULL)), []) AS suppliers
FROM part LEFT JOIN (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 49) ON l_partkey = p_partkey
WHERE p_size = 3 GROUP BY p_partkey, p_name ORDER BY n DESC, part LIMIT 50""")
def q08(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    large = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("part:"), "l_partkey").alias("id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("o")).distinct()
    targets = P.with_node(large, g.of("supplier"), "o", "o")
    rows = P.optional(g.of("part").where(attr("p_size") == "3"), targets, "id")
    out = rows.groupBy("id", F.col("name").alias("part")).agg(F.countDistinct("o_name").alias("n"), P.first_items("o_name").alias("suppliers")).drop("id")
    return P.top(out, 50, desc("n"), F.asc_nulls_last("part"), asc("suppliers"))  # nulls as SQL has them, which leaves equal n and part open


@query("q09_grouped_count_with_examples", """
SELECT r_name AS region, count(*) AS n, list_sort(list(DISTINCT n_name))[1:8] AS examples FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def q09(spark: SparkSession, d: str) -> DataFrame:
    h = P.hop(star_graph(spark, d), ("nationInRegion",))
    return P.counted_with_first(h.withColumnRenamed("o_name", "region"), "region", "s_name", 8, "examples")


@query("q10_most_loaded_sources", """
SELECT s_name AS supplier, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name ORDER BY n DESC, supplier LIMIT 15""")
def q10(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    # An edge's key is its triple, so edges count distinct parts.
    n = g.typed("partFromSupplier").groupBy(F.col("object_id").alias("o")).agg(F.count("*").alias("n"))
    return P.top(P.with_node(n, g.of("supplier"), "o", "o").select(F.col("o_name").alias("supplier"), "n"), 15, desc("n"), asc("supplier"))


@query("q11_exclusion_edges", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 50""")
def q11(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_partkey")
    return P.top(lines, 50, asc("l_orderkey"), asc("l_linenumber"), asc("l_partkey"))


@query("q12_by_attribute", """
SELECT p_brand AS brand, count(*) AS n, list_sort(list(DISTINCT s_name))[1:6] AS suppliers FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_brand""")
def q12(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    h = P.hop(g, ("partFromSupplier",), columns=("name", "attrs"), subjects=g.of("part"), objects=g.of("supplier"))
    return P.counted_with_first(h.select(attr("p_brand", "s_attrs").alias("brand"), "o_name"), "brand", "o_name", 6, "suppliers")


@query("q13_chain_with_optional_hop", """
SELECT r_name AS region, n_name AS nation, coalesce(list_sort(list(s_name) FILTER (s_name IS NOT NULL)), []) AS suppliers
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def q13(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    first = P.hop(g, ("nationInRegion",), "n", "r")
    rich = g.of("supplier").where(attr("s_acctbal").cast("double") > 9000)
    second = P.with_node(g.typed("supplierInNation").select(F.col("subject_id").alias("s"), F.col("object_id").alias("n")), rich, "s", "s")
    rows = P.optional(first, second, "n")
    return rows.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sort_array(F.collect_list("s_name")).alias("suppliers"))


@query("q14_types_with_examples", """
SELECT p_type AS type, count(*) AS n, list_sort(list(DISTINCT p_name))[1:5] AS examples FROM part GROUP BY p_type""")
def q14(spark: SparkSession, d: str) -> DataFrame:
    parts = star_graph(spark, d).of("part")
    return P.counted_with_first(parts.select(attr("p_type").alias("type"), "name"), "type", "name", 5, "examples")


@query("q15_items_of_one_diagnosis", """
SELECT p_brand AS brand, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE o_orderpriority = '1-URGENT' GROUP BY p_brand ORDER BY n DESC, brand LIMIT 20""")
def q15(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    cases = g.of("order").where(attr("o_orderpriority") == "1-URGENT")
    h = P.hop(g, ("orderHasPart",), columns=("attrs",), subjects=cases, objects=g.of("part"))
    rows = h.select("s", attr("p_brand", "o_attrs").alias("brand")).distinct().groupBy("brand").agg(F.count("*").alias("n"))
    return P.top(rows, 20, desc("n"), asc("brand"))


@query("q16_optional_group_with_null", """
SELECT quality, count(DISTINCT d.doc_id) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE lang = 'en' GROUP BY quality""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    rows = P.optional(docs, table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("quality").agg(F.countDistinct("doc_id").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("quality"))


@query("q17_item_pairs", """
WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 20""")
def q17(spark: SparkSession, d: str) -> DataFrame:
    baskets = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    pairs = P.pairs_within(baskets, "l_orderkey", "p_brand").groupBy("a", "b").agg(F.count("*").alias("n"))
    return P.top(pairs, 20, desc("n"), asc("a"), asc("b"))


@query("q18_item_with_optional_patterns", """
SELECT s_name AS supplier, count(DISTINCT r_name) AS n, coalesce(list_sort(list(DISTINCT r_name) FILTER (r_name IS NOT NULL))[1:3], []) AS regions
FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1) ON n_nationkey = s_nationkey GROUP BY s_suppkey, s_name""")
def q18(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    to_nation = g.typed("supplierInNation").select(F.col("subject_id").alias("id"), F.col("object_id").alias("n"))
    to_region = P.with_node(g.typed("nationInRegion").select(F.col("subject_id").alias("n"), F.col("object_id").alias("r")), g.of("region").where(F.substring_index("id", ":", -1).cast("int") > 1), "r", "r")
    rows = P.optional(g.of("supplier"), to_nation.join(to_region, "n"), "id")
    return rows.groupBy("id", F.col("name").alias("supplier")).agg(F.countDistinct("r_name").alias("n"), P.first_items("r_name", 3).alias("regions")).drop("id")


@query("q19_one_case_in_full", """
SELECT 'orderByCustomer' AS type, 'customer:' || o_custkey AS target FROM orders WHERE o_orderkey = 33
UNION ALL SELECT DISTINCT 'orderHasPart', 'part:' || l_partkey FROM lineitem WHERE l_orderkey = 33""")
def q19(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbourhood(star_graph(spark, d), "order:33").where("direction = 'out'").select("type", F.col("other").alias("target"))


@query("q20_grouped_by_place", """
SELECT n_name AS nation, count(*) AS n, list_sort(list(DISTINCT c_name))[1:5] AS examples FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def q20(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    h = P.hop(g, ("customerInNation",), subjects=g.of("customer"), objects=g.of("nation"))
    return P.counted_with_first(h.withColumnRenamed("o_name", "nation"), "nation", "s_name", 5, "examples")


@query("q21_families_by_size", """
SELECT c_mktsegment AS segment, len(list(DISTINCT n_name)) AS n, list_sort(list(DISTINCT n_name)) AS nations FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_acctbal > 9500 GROUP BY 1 ORDER BY n DESC, segment""")
def q21(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    rich = g.of("customer").where(attr("c_acctbal").cast("double") > 9500)
    h = P.hop(g, ("customerInNation",), columns=("name", "attrs"), subjects=rich, objects=g.of("nation"))
    rows = h.groupBy(attr("c_mktsegment", "s_attrs").alias("segment")).agg(P.first_items("o_name").alias("nations"))
    return rows.select("segment", F.size("nations").cast("long").alias("n"), "nations").orderBy(desc("n"), "segment")


@query("q22_optional_place", """
SELECT s_name AS supplier, p_name AS part, n_name AS nation FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON n_nationkey = s_nationkey WHERE p_size = 11""")
def q22(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    h = P.hop(g, ("partFromSupplier",), "p", "s", subjects=g.of("part").where(attr("p_size") == "11"), objects=g.of("supplier"))
    in_one = g.of("nation").where(attr("n_regionkey") == "1")
    place = P.with_node(g.typed("supplierInNation").select(F.col("subject_id").alias("s"), F.col("object_id").alias("n")), in_one, "n", "n")
    rows = P.optional(h, place, "s").select(F.col("s_name").alias("supplier"), F.col("p_name").alias("part"), F.col("n_name").alias("nation"))
    return rows.orderBy(F.asc_nulls_last("nation"), "supplier", "part")


@query("q23_three_hops_last_reversed", """
SELECT r_name AS region, count(DISTINCT l_partkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY r_name""")
def q23(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    places = P.with_node(g.typed("nationInRegion").select(F.col("subject_id").alias("n"), F.col("object_id").alias("r")), g.of("region"), "r", "r")
    suppliers = g.typed("supplierInNation").select(F.col("subject_id").alias("s"), F.col("object_id").alias("n"))
    parts = g.typed("partFromSupplier").select(F.col("subject_id").alias("p"), F.col("object_id").alias("s"))
    rows = parts.join(suppliers.join(places, "n").select("s", "r_name"), "s").select("r_name", "p").distinct()
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"))


@query("q24_layer_by_type", """
SELECT layer, type, count(*) AS n FROM (SELECT 'geo' AS layer, 'nationInRegion' AS type FROM nation UNION ALL SELECT 'geo', 'customerInNation' FROM customer UNION ALL SELECT 'geo', 'supplierInNation' FROM supplier
UNION ALL SELECT 'commerce', 'orderByCustomer' FROM orders UNION ALL SELECT 'commerce', 'orderHasPart' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
UNION ALL SELECT 'supply', 'partFromSupplier' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) GROUP BY 1, 2""")
def q24(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).edges.groupBy("layer", "type").agg(F.count("*").alias("n"))


@query("q25_isolates_per_kind", f"""
WITH e AS ({edges_sql()}), n AS ({nodes_sql()}), x AS (SELECT s AS id FROM e UNION SELECT o FROM e)
SELECT cls, count(*) FILTER (x.id IS NULL) AS n FROM n LEFT JOIN x ON x.id = n.id GROUP BY cls""")
def q25(spark: SparkSession, d: str) -> DataFrame:
    # Each kind has a row, if only with 0.
    marks = [x.select("cls", F.lit(n).alias("n")) for nodes, ends in kinds(spark, d) for x, n in ((nodes, 0), (P.apart(nodes, "key", *ends), 1))]
    return reduce(DataFrame.union, marks).groupBy("cls").agg(F.sum("n").alias("n"))


@query("q26_failed_evidence", """
WITH f AS (SELECT item_id, text, exists(SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS found FROM benchmark b)
SELECT found, count(*) AS n, list_sort(list(item_id))[1:3] AS examples FROM f GROUP BY found""")
def q26(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    hits = quoted(items, table(spark, d, "documents"), "item_id", "text", "doc_id", "text").select("item_id").distinct()
    found = items.join(hits.withColumn("hit", F.lit(True)), "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("found"))
    return P.counted_with_first(found, "found", "item_id", 3, "examples")


@query("q27_everything_from_one_passage", """
SELECT l_linenumber AS line, 'part:' || l_partkey AS part_id, 'supplier:' || l_suppkey AS supplier_id FROM lineitem WHERE l_orderkey = 100""")
def q27(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_orderkey = 100")
    return lines.select(F.col("l_linenumber").alias("line"), F.concat(F.lit("part:"), "l_partkey").alias("part_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("supplier_id"))


@query("q28_corpus_by_layer", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def q28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("q29_cardinality_breakers", """
SELECT p_name AS part, len(list(DISTINCT s_name)) AS n, list_sort(list(DISTINCT s_name)) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
GROUP BY p_partkey, p_name HAVING len(list(DISTINCT s_name)) > 35""")
def q29(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    h = P.hop(g, ("partFromSupplier",), subjects=g.of("part"), objects=g.of("supplier"))
    rows = h.groupBy("s", F.col("s_name").alias("part")).agg(P.first_items("o_name").alias("suppliers")).where(F.size("suppliers") > 35)
    return rows.select("part", F.size("suppliers").cast("long").alias("n"), "suppliers").orderBy(desc("n"), "part")


@query("sparql1_attribute_literal", """
SELECT p_name AS part, s_name AS supplier FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_type = 'PROMO' AND p_size = 5""")
def sparql1(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    t = triples(g, lang="en", types=("partFromSupplier",), classes=("part", "supplier"))
    has = lambda p, v: t.where((F.col("p") == p) & (F.col("o") == v) & (F.col("lang") == "en")).select("s")
    name = t.where("p = 'name'").select("s", "o")
    parts = has("p_type", "PROMO").join(has("p_size", "5"), "s")
    links = t.where("p = 'partFromSupplier'").select("s", F.col("o").alias("t")).join(parts, "s")
    return links.join(name.toDF("s", "part"), "s").join(name.toDF("t", "supplier"), "t").select("part", "supplier")


def provenance(edges: DataFrame) -> DataFrame:
    """Subject, object and each support of each edge, by way of its statement.

    A statement's rows are met in one grouping, not by joins: its name tells its subject and object, only its supports may be several.
    """
    s = statements(edges, ("n_support",))
    of = lambda p: F.when(F.col("p") == p, F.col("o"))
    rows = s.where(F.col("p") != "predicate").groupBy("s").agg(F.max(of("subject")).alias("subject"), F.max(of("object")).alias("object"), F.collect_set(of("n_support").cast("long")).alias("each"))
    return rows.where("subject is not null and object is not null").select("subject", "object", F.explode("each").alias("n_support"))


@query("sparql2_statements_with_provenance", """
SELECT 'order:' || l_orderkey AS subject, 'part:' || l_partkey AS object, count(*) AS n_support FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY l_orderkey, l_partkey""")
def sparql2(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    urgent = g.of("order").where(attr("o_orderpriority") == "1-URGENT").select(F.col("id").alias("subject_id"))
    return provenance(g.typed("orderHasPart").join(urgent, "subject_id", "left_semi"))
