"""Aggregates, rankings, quality, mining and graph queries over the star graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.privacy import RECORD
from ..model import Graph
from ..operators import graph as G
from ..operators import mining as M
from ..operators import pattern as P
from ..operators import quality as Q
from ..operators import stats as S
from ..sources.readers import script_of
from ..sources.testdata import edges_sql, node_id, nodes_sql, ontology_sql, star_graph, star_ontology, table
from .registry import query

VIEWS = f"e AS ({edges_sql()}), n AS ({nodes_sql()}), ont(type, domain, range, card) AS ({ontology_sql()})"
BASKETS = "b AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey)"


def purchased(spark: SparkSession, d: str) -> DataFrame:
    """basket, item of each line."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    return table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("basket")).join(parts, "l_partkey").select("basket", "item")


def baskets(spark: SparkSession, d: str) -> DataFrame:
    return purchased(spark, d).distinct()


def purchases(spark: SparkSession, d: str) -> Graph:
    """All customers and orders, joined by who ordered: a component for each customer, those without orders alone."""
    graph = star_graph(spark, d)
    return Graph(graph.of("customer", "order"), graph.typed("orderByCustomer"))


PURCHASES = """m AS (SELECT 'customer:' || c_custkey AS id, 'customer:' || c_custkey AS root FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, CASE WHEN c_custkey IS NULL THEN 'order:' || o_orderkey ELSE 'customer:' || c_custkey END FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
s AS (SELECT root, count(*) AS size FROM m GROUP BY root)"""


@query("a01_node_counts", f"WITH {VIEWS} SELECT cls, count(*) AS n FROM n GROUP BY cls")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).nodes.groupBy("cls").agg(F.count("*").alias("n"))


@query("a03_flag_by_check", """
SELECT quality, toxic, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY quality) AS share FROM labels GROUP BY quality, toxic""")
def a03(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return cells.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("quality")))


@query("a04_distinct_counts", """
SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT n_chars) AS lengths FROM documents GROUP BY source""")
def a04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("n_chars").alias("lengths"))


@query("a07_degree", f"""
WITH {VIEWS}, x AS (SELECT s AS id, n_support FROM e UNION ALL SELECT o, n_support FROM e)
SELECT id, count(*) AS degree, sum(n_support)::BIGINT AS strength FROM x GROUP BY id""")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return P.degree(star_graph(spark, d).edges, "n_support")


@query("a10_modes", """
WITH c AS (SELECT o_orderpriority AS g, l_quantity AS v, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
t AS (SELECT g, sum(n) AS total, max(n) AS best FROM c GROUP BY g)
SELECT c.g AS priority, list_sort(list(v)) AS modes, sum(n) / max(total) AS share FROM c JOIN t ON t.g = c.g AND n = best GROUP BY c.g""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    return S.modes(rows.join(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey"), ["priority"], "l_quantity")


@query("a11_conditional_counts", """
SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER (l_quantity <= 2) AS up_to_2, count(*) FILTER (l_discount = 0) AS no_discount,
  round(100.0 * count(*) FILTER (l_quantity <= 2) / count(*), 1) AS share FROM lineitem GROUP BY 1""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") <= 2).alias("up_to_2"), F.count_if(F.col("l_discount") == 0).alias("no_discount"))
    return rows.withColumn("share", S.percent(F.col("up_to_2"), F.col("n")))


@query("a13_summary", """
SELECT p_brand AS brand, count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, quantile_cont(l_quantity, 0.5) AS median, min(l_quantity) AS least, max(l_quantity) AS most
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(quantities(spark, d), ["brand"], "l_quantity")


def quantities(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), "p_type", "p_size")
    return table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", "l_returnflag").join(parts, "l_partkey")


@query("a15_exclusive_quartiles", """
WITH x AS (SELECT p_brand AS brand, l_quantity AS v, row_number() OVER (PARTITION BY p_brand ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
q AS (SELECT brand, n, p, least(greatest(floor(p * (n + 1)), 1), n - 1) AS spot, max(p * (n + 1)) AS h FROM x, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(p) GROUP BY brand, n, p),
y AS (SELECT q.brand, q.n, p, lo.v + (hi.v - lo.v) * (h - spot) AS v FROM q JOIN x lo ON lo.brand = q.brand AND lo.r = spot JOIN x hi ON hi.brand = q.brand AND hi.r = spot + 1)
SELECT brand, n, max(v) FILTER (p = 0.25) AS q1, max(v) FILTER (p = 0.5) AS q2, max(v) FILTER (p = 0.75) AS q3 FROM y GROUP BY brand, n""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return S.exclusive_quartiles(quantities(spark, d), ["brand"], "l_quantity")


@query("a16_box", """
SELECT p_type AS type, quantile_cont(l_quantity, [0.05, 0.25, 0.5, 0.75, 0.95]) AS box FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 0 GROUP BY 1""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return S.box(quantities(spark, d).where("l_quantity > 0").withColumnRenamed("p_type", "type"), ["type"], "l_quantity")


@query("a17_threshold_shares", """
SELECT p_brand AS brand, avg((l_quantity <= 2)::INT) AS le2, avg((l_quantity <= 3)::INT) AS le3, avg((l_quantity > 5)::INT) AS gt5 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(*) >= 20""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c, name: F.avg(c.cast("int")).alias(name)
    q = F.col("l_quantity")
    return quantities(spark, d).groupBy("brand").agg(share(q <= 2, "le2"), share(q <= 3, "le3"), share(q > 5, "gt5"), F.count("*").alias("n")).where("n >= 20").drop("n")


@query("a20_composition", """
WITH u AS (SELECT p_type AS type, p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, brand) AS r FROM u)
SELECT type, sum(n)::BIGINT AS uses, count(DISTINCT brand) AS kinds, list(brand ORDER BY r) FILTER (r <= 5) AS leading FROM k GROUP BY type""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    uses = quantities(spark, d).groupBy(F.col("p_type").alias("type"), "brand").agg(F.count("*").alias("n"))
    ranked = uses.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "brand")))
    leading = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "brand")))), lambda x: x["brand"])
    return ranked.groupBy("type").agg(F.sum("n").alias("uses"), F.countDistinct("brand").alias("kinds"), leading.alias("leading"))


@query("a21_exploded_weights", """
SELECT w AS word, sum(n)::BIGINT AS weight, count(*) AS items FROM (SELECT unnest(string_split(p_name, ' ')) AS w, n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) GROUP BY 1""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    words = table(spark, d, "part").join(uses, F.col("p_partkey") == F.col("l_partkey")).select(F.explode(F.split("p_name", " ")).alias("word"), "n")
    return words.groupBy("word").agg(F.sum("n").alias("weight"), F.count("*").alias("items"))


@query("a24_cardinality_exceptions", f"""
WITH {VIEWS}, p AS (SELECT type, s, count(*) AS c, count(DISTINCT o) AS k FROM e WHERE type IN (SELECT type FROM ont WHERE card = '0..1') GROUP BY 1, 2)
SELECT type, count(*) AS by_rows, count(*) FILTER (k > 1) AS by_objects FROM p WHERE c > 1 GROUP BY type""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return Q.cardinality_exceptions(star_graph(spark, d).edges, star_ontology(spark))


@query("a25_profiles", """
WITH c AS (SELECT o_orderpriority AS p, p_brand AS brand, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, brand) AS r FROM c)
SELECT p AS priority, list(brand ORDER BY r) AS brands, (SELECT count(*) FROM orders WHERE o_orderpriority = p) AS n_cases FROM k WHERE r <= 6 GROUP BY p""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("basket"), F.col("o_orderpriority").alias("priority"))
    n = orders.groupBy("priority").agg(F.count("*").alias("n_cases"))
    counts = baskets(spark, d).join(orders, "basket").groupBy("priority", "item").agg(F.count("*").alias("n"))
    best = P.top_per_group(counts, 6, ["priority"], F.desc("n"), F.asc("item"))
    named = best.groupBy("priority").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("brands"))
    return named.join(n, "priority")


@query("a27_degree_ccdf", f"""
WITH {VIEWS}, x AS (SELECT id, count(*) AS k FROM (SELECT s AS id FROM e UNION ALL SELECT o FROM e) GROUP BY id), c AS (SELECT k, count(*) AS n FROM x GROUP BY k)
SELECT k, n, sum(n) OVER (ORDER BY k DESC) / (SELECT count(*) FROM x) AS share FROM c""")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return S.ccdf(P.degree(star_graph(spark, d).edges), "degree")


@query("a28_component_sizes", f"WITH {PURCHASES} SELECT size, count(*) AS n FROM s GROUP BY size")
def a28(spark: SparkSession, d: str) -> DataFrame:
    members = G.components(purchases(spark, d))
    return members.select("component", "size").distinct().groupBy("size").agg(F.count("*").alias("n"))


@query("a31_lift_and_fisher_q", """
WITH o AS (SELECT o_orderkey AS basket, o_orderpriority AS class FROM orders), b AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT count(*) AS n FROM o), i AS (SELECT item, count(*) AS ni FROM b GROUP BY 1), c AS (SELECT class, count(*) AS nc FROM o GROUP BY 1),
x AS (SELECT item, class, count(*) AS a FROM b JOIN o USING (basket) GROUP BY 1, 2),
g AS (SELECT i.item, c.class, coalesce(a, 0) AS a, ni - coalesce(a, 0) AS b, nc - coalesce(a, 0) AS c, n - ni - nc + coalesce(a, 0) AS d, ni, nc, n, ((ni + 1) * (nc + 1)) // (n + 2) AS likeliest
  FROM i, c, t LEFT JOIN x ON x.item = i.item AND x.class = c.class),
k AS (SELECT *, unnest(range(greatest(0, ni + nc - n), least(ni, nc) + 1)) AS k FROM g),
w AS (SELECT item, class, a, b, c, d, k, exp(lgamma(likeliest + 1) - lgamma(k + 1) + lgamma(ni - likeliest + 1) - lgamma(ni - k + 1) + lgamma(nc - likeliest + 1) - lgamma(nc - k + 1)
  + lgamma(n - ni - nc + likeliest + 1) - lgamma(n - ni - nc + k + 1)) AS w FROM k),
p AS (SELECT item, class, a, b, c, d, coalesce(sum(w) FILTER (k >= a), 0) / sum(w) AS p FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY p, item, class) AS r, count(*) OVER () AS m FROM p)
SELECT item, class, a, b, c, d, CASE WHEN a = 0 THEN 0 ELSE a * (a + b + c + d)::DOUBLE / ((a + b) * (a + c)) END AS lift,
  round(p, 8) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM r""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return S.lift(brand_tests(spark, d)).select("item", "class", "a", "b", "c", "d", "lift", "p", "q")


def brand_tests(spark: SparkSession, d: str) -> DataFrame:
    """item, class, the cells of orders, p and q."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("basket"), F.col("o_orderpriority").alias("class"))
    n = table(spark, d, "lineitem").count()
    members = G.dealt(orders, n, "basket").join(G.dealt(purchased(spark, d), n, "basket"), "basket", "left")
    rows = S.tested(S.contingency(members, "item", "class", "basket"), "item", "class")
    return rows.withColumn("p", F.round("p", 8)).withColumn("q", F.round("q", 8))


@query("g18_fisher_bh", """
WITH o AS (SELECT o_orderkey AS basket, o_orderpriority AS class FROM orders), b AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT count(*) AS n FROM o), i AS (SELECT item, count(*) AS ni FROM b GROUP BY 1), c AS (SELECT class, count(*) AS nc FROM o GROUP BY 1),
x AS (SELECT item, class, count(*) AS a FROM b JOIN o USING (basket) GROUP BY 1, 2),
g AS (SELECT i.item, c.class, coalesce(a, 0) AS a, ni, nc, n FROM i, c, t LEFT JOIN x ON x.item = i.item AND x.class = c.class),
k AS (SELECT item, class, a, ni, nc, n, unnest(range(a, least(ni, nc) + 1)) AS k FROM g),
p AS (SELECT item, class, least(1.0, sum(exp(lgamma(ni + 1) - lgamma(k + 1) - lgamma(ni - k + 1) + lgamma(n - ni + 1) - lgamma(nc - k + 1) - lgamma(n - ni - nc + k + 1) - lgamma(n + 1) + lgamma(nc + 1) + lgamma(n - nc + 1)))) AS p FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY p, item, class) AS r, count(*) OVER () AS m FROM p)
SELECT item, class, round(p, 8) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM r""")
def g18(spark: SparkSession, d: str) -> DataFrame:
    return brand_tests(spark, d).select("item", "class", "p", "q")


@query("a35_corpus_stats", """
SELECT lang, count(*) AS passages, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest, quantile_cont(length(text), 0.5) AS median FROM documents GROUP BY lang""")
def a35(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text").cast("long")
    rows = table(spark, d, "documents").select("lang", n.alias("n"))
    median = S.quantiles(rows, ["lang"], "n", {"median": 0.5}).select("lang", "median")
    return rows.groupBy("lang").agg(F.count("*").alias("passages"), F.sum("n").alias("chars"), F.max("n").alias("longest")).join(median, "lang")


@query("a36_extremes", """
SELECT lang, arg_min(doc_id, (n_chars, doc_id)) AS shortest, arg_max(doc_id, (n_chars, doc_id)) AS longest FROM documents GROUP BY lang""")
def a36(spark: SparkSession, d: str) -> DataFrame:
    key = F.struct("n_chars", "doc_id")
    return table(spark, d, "documents").groupBy("lang").agg(F.min_by("doc_id", key).alias("shortest"), F.max_by("doc_id", key).alias("longest"))


@query("a37_audit", f"""
WITH {VIEWS}, j AS (SELECT e.*, a.cls AS sc, b.cls AS oc, domain, range FROM e LEFT JOIN n a ON a.id = s LEFT JOIN n b ON b.id = o LEFT JOIN ont ON ont.type = e.type),
c AS (SELECT type, s, count(*) AS c, count(DISTINCT o) AS k FROM e WHERE type IN (SELECT type FROM ont WHERE card = '0..1') GROUP BY 1, 2)
SELECT 'nodes' AS metric, cls AS key, count(*) AS value FROM n GROUP BY cls
UNION ALL SELECT 'edges', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'layer', layer, count(*) FROM e GROUP BY layer
UNION ALL SELECT 'isolates', cls, count(*) FROM n WHERE id NOT IN (SELECT s FROM e UNION SELECT o FROM e) GROUP BY cls
UNION ALL SELECT 'integrity', 'dangling', count(*) FILTER (sc IS NULL OR oc IS NULL) FROM j UNION ALL SELECT 'integrity', 'self_loop', count(*) FILTER (s = o) FROM j
UNION ALL SELECT 'integrity', 'undeclared', count(*) FILTER (domain IS NULL) FROM j UNION ALL SELECT 'integrity', 'domain', count(*) FILTER (domain <> sc) FROM j
UNION ALL SELECT 'integrity', 'range', count(*) FILTER (range <> oc) FROM j UNION ALL SELECT 'integrity', 'duplicate', (count(*) - count(DISTINCT (s, o, type))) FROM e
UNION ALL SELECT 'cardinality', type, count(*) FILTER (k > 1) FROM c WHERE c > 1 GROUP BY type""")
def a37(spark: SparkSession, d: str) -> DataFrame:
    return Q.audit(star_graph(spark, d), star_ontology(spark))


@query("a38_pattern_totals", """
SELECT source, sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS numbers FROM documents GROUP BY source""")
def a38(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[0-9]+"))).alias("numbers"))


@query("a39_totals_by_rollup", """
SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)""")
def a39(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


@query("a41_union_of_leaders", """
WITH c AS (SELECT o_orderpriority AS p, p_brand AS brand, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, brand) AS r FROM c), t AS (SELECT brand, sum(n)::BIGINT AS n FROM c GROUP BY 1)
SELECT brand AS item, n FROM t WHERE brand IN (SELECT brand FROM k WHERE r <= 8)""")
def a41(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("basket"), F.col("o_orderpriority").alias("priority"))
    counts = baskets(spark, d).join(orders, "basket").groupBy("priority", "item").agg(F.count("*").alias("n"))
    leaders = P.top_per_group(counts, 8, ["priority"], F.desc("n"), F.asc("item")).select("item").distinct()
    return counts.groupBy("item").agg(F.sum("n").alias("n")).join(leaders, "item", "left_semi").orderBy(F.desc("n"), "item")


@query("a42_top_types_per_layer", f"""
WITH {VIEWS}, c AS (SELECT layer, type, count(*) AS n FROM e GROUP BY 1, 2) SELECT layer, type, n, row_number() OVER (PARTITION BY layer ORDER BY n DESC, type) AS rank FROM c QUALIFY rank <= 2""")
def a42(spark: SparkSession, d: str) -> DataFrame:
    counts = star_graph(spark, d).edges.groupBy("layer", "type").agg(F.count("*").alias("n"))
    return P.top_per_group(counts, 2, ["layer"], F.desc("n"), F.asc("type"))


@query("w01_global_rank", "SELECT brand, n, row_number() OVER (ORDER BY n DESC, brand) AS rank FROM (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1)")
def w01(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "brand")))


@query("w02_positional_join", """
WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS r FROM lineitem)
SELECT x.l_orderkey AS order_key, x.l_linenumber AS line, y.l_linenumber AS other FROM a x LEFT JOIN a y ON y.l_orderkey = x.l_orderkey AND y.l_partkey = x.l_partkey AND y.r = x.r + 1""")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return followed(table(spark, d, "lineitem"))


def followed(lines: DataFrame) -> DataFrame:
    """Each line with the next line of the same order and part, if any."""
    lines = lines.select("l_orderkey", "l_partkey", "l_linenumber")
    ranked = lines.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber")))
    later = ranked.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("other"), (F.col("r") - 1).alias("r"))
    return ranked.join(later, ["l_orderkey", "l_partkey", "r"], "left").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), "other")


@query("w05_rank_comparison", """
WITH a AS (SELECT item, row_number() OVER (ORDER BY n DESC, item) AS r FROM (SELECT p_brand AS item, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1)),
b AS (SELECT item, row_number() OVER (ORDER BY n DESC, item) AS r FROM (SELECT p_brand AS item, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1))
SELECT coalesce(x.item, y.item) AS item, x.r AS narrow, y.r AS broad FROM (SELECT * FROM a WHERE r <= 20) x FULL JOIN (SELECT * FROM b WHERE r <= 20) y ON x.item = y.item""")
def w05(spark: SparkSession, d: str) -> DataFrame:
    lines = quantities(spark, d)

    def best(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy(F.col("brand").alias("item")).agg(F.count("*").alias("n"))
        return counts.withColumn(name, F.row_number().over(Window.orderBy(F.desc("n"), "item"))).where(F.col(name) <= 20).drop("n")

    return best(lines.where("l_returnflag = 'R'"), "narrow").join(best(lines, "broad"), "item", "full").select("item", "narrow", "broad")


@query("w08_spearman", """
WITH x AS (SELECT p_brand AS item, count(*) AS n, avg(l_quantity) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
r AS (SELECT item, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rq FROM x)
SELECT round(corr(rn, rq), 9) AS rho, count(*) AS n FROM r""")
def w08(spark: SparkSession, d: str) -> DataFrame:
    rows = quantities(spark, d).groupBy("brand").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    return S.spearman(rows, "n", "q").select(F.round("rho", 9).alias("rho"), "n")


@query("o07_categorical_order", """
SELECT o_orderpriority AS priority, n, row_number() OVER (ORDER BY coalesce(list_position(['5-LOW', '1-URGENT'], o_orderpriority), 99), o_orderpriority) AS place FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def o07(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    at = F.array_position(F.array(F.lit("5-LOW"), F.lit("1-URGENT")), F.col("priority"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.when(at > 0, at).otherwise(99), "priority")))


@query("u01_set_operations", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def u01(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    a, b = lines.where("l_returnflag = 'R'").select("l_partkey").distinct(), lines.where("l_quantity > 40").select("l_partkey").distinct()
    n = lambda rows, op: rows.agg(F.lit(op).alias("op"), F.count("*").alias("n")).select("op", "n")
    return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "intersect")).union(n(a.subtract(b), "except"))


@query("u05_baskets_that_hold_an_itemset", f"WITH {BASKETS} SELECT basket FROM b WHERE item IN ('Brand#1', 'Brand#2') GROUP BY basket HAVING count(*) = 2")
def u05(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["Brand#1", "Brand#2"]
    return baskets(spark, d).where(F.col("item").isin(*wanted)).groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("basket")


@query("j15_endpoint_or_flag", """
SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_acctbal > 9900""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 400000")
    told = F.array(F.struct(F.when(F.col("c_acctbal") > 9900, "own / account").otherwise("other / account").alias("chapter_path")))
    edges = orders.select(node_id("order", "o_orderkey").alias("subject_id"), node_id("customer", "o_custkey").alias("object_id"), F.lit("own").alias("corpus"))
    nodes = customers.select(node_id("customer", "c_custkey").alias("id"), "c_custkey", told.alias("provenance"))
    return G.edition(Graph(nodes, edges), ["own"]).nodes.select(F.col("c_custkey").alias("id"))


@query("j18_lookup_with_self_default", """
SELECT p_partkey AS part, coalesce(std, p_brand) AS brand FROM part LEFT JOIN (VALUES ('Brand#1', 'Brand#01'), ('Brand#2', 'Brand#02')) m(raw, std) ON raw = p_brand""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    brand = X.mapped(F.col("p_brand"), {"Brand#1": "Brand#01", "Brand#2": "Brand#02"})
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), brand.alias("brand"))


@query("j20_grid_with_zero_cells", """
SELECT p_type AS type, size, count(p_partkey) AS n FROM (SELECT DISTINCT p_type AS t FROM part) CROSS JOIN (SELECT unnest(range(0, 52)) AS size) LEFT JOIN part ON p_type = t AND p_size = size GROUP BY t, p_type, size HAVING t IS NOT NULL AND p_type IS NOT NULL
UNION ALL SELECT t, size, 0 FROM (SELECT DISTINCT p_type AS t FROM part) CROSS JOIN (SELECT unnest(range(0, 52)) AS size) WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_type = t AND p_size = size)""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"))
    sizes = spark.range(52).select((-F.col("id") - 1).alias("unit"), F.lit(None).cast("string").alias("type"), F.col("id").alias("size"))
    return S.contingency(members.union(sizes), "type", "size", "unit").select("type", "size", F.col("a").alias("n"))


@query("g01_components", f"WITH {PURCHASES}, k AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, root) - 1 AS component FROM s) SELECT id, component, size FROM m JOIN k USING (root)")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return G.components(purchases(spark, d))


@query("g02_topology", f"""WITH {PURCHASES} SELECT sum(size)::BIGINT AS nodes, count(*) AS components, max(size) AS largest, count(*) FILTER (size > 1) - 1 AS satellites, count(*) FILTER (size = 1) AS isolates, round(100.0 * sum(size) FILTER (size > 1) / sum(size), 1) AS connected FROM s""")
def g02(spark: SparkSession, d: str) -> DataFrame:
    return G.topology(G.components(purchases(spark, d)))


@query("g03_edition_subgraph", f"""
WITH {VIEWS}, x AS (SELECT * FROM e WHERE layer = 'geo') SELECT cls, count(*) AS n FROM n WHERE id IN (SELECT s FROM x UNION SELECT o FROM x) GROUP BY cls""")
def g03(spark: SparkSession, d: str) -> DataFrame:
    return G.edition(star_graph(spark, d), ["geo"], "layer").nodes.groupBy("cls").agg(F.count("*").alias("n"))


@query("g04_preview_subgraph", f"""
WITH {VIEWS}, x AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM e UNION ALL SELECT o FROM e) GROUP BY id),
t AS (SELECT id FROM x JOIN n USING (id) WHERE degree >= CASE cls WHEN 'order' THEN 8 ELSE 2 END ORDER BY degree DESC, id LIMIT 420)
SELECT type, count(*) AS n FROM e WHERE s IN (SELECT id FROM t) AND o IN (SELECT id FROM t) GROUP BY type""")
def g04(spark: SparkSession, d: str) -> DataFrame:
    return G.preview(star_graph(spark, d), {"order": 8}).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("g09_cooccurrence_network", f"WITH {BASKETS} SELECT x.item AS a, y.item AS b, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 13")
def g09(spark: SparkSession, d: str) -> DataFrame:
    return M.cooccurrence(baskets(spark, d), "basket", "item", 13)


@query("g11_modularity", """
WITH b AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey), w AS (SELECT x.item AS a, y.item AS b, count(*) AS w FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2),
c AS (SELECT *, right(a, 1) AS ca, right(b, 1) AS cb FROM w), t AS (SELECT c, sum(w) AS tot, sum(i) AS ins FROM (SELECT ca AS c, w, CASE WHEN ca = cb THEN w ELSE 0 END AS i FROM c UNION ALL SELECT cb, w, 0 FROM c) GROUP BY c)
SELECT round(sum(ins / m - (tot / (2 * m)) ** 2), 9) AS q FROM t, (SELECT sum(w) AS m FROM w)""")
def g11(spark: SparkSession, d: str) -> DataFrame:
    edges = M.cooccurrence(baskets(spark, d), "basket", "item").withColumnRenamed("n", "w")
    member = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.substring("p_brand", -1, 1).alias("community")).distinct()
    return G.modularity(edges, member).select(F.round("q", 9).alias("q"))


@query("g13_itemsets", f"""
WITH {BASKETS}, t AS (SELECT 0.005 * count(DISTINCT basket) AS least FROM b)
SELECT [item] AS items, count(*) AS n FROM b GROUP BY item HAVING count(*) >= (SELECT least FROM t)
UNION ALL SELECT [x.item, y.item], count(*) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY x.item, y.item HAVING count(*) >= (SELECT least FROM t)
UNION ALL SELECT [x.item, y.item, z.item], count(*) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item JOIN b z ON z.basket = x.basket AND y.item < z.item GROUP BY x.item, y.item, z.item HAVING count(*) >= (SELECT least FROM t)""")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return M.itemsets(baskets(spark, d), "basket", "item", 0.005)


@query("g14_rules", f"""
WITH {BASKETS}, t AS (SELECT count(DISTINCT basket) AS n FROM b), s1 AS (SELECT item, count(*) AS n FROM b GROUP BY 1),
s2 AS (SELECT x.item AS i, y.item AS j, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT n FROM t)),
r AS (SELECT i AS a, j AS c, n FROM s2 UNION ALL SELECT j, i, n FROM s2),
q AS (SELECT [a] AS antecedent, [c] AS consequent, r.n, r.n / t.n::DOUBLE AS support, r.n / x.n::DOUBLE AS confidence, (r.n / x.n::DOUBLE) / (y.n / t.n::DOUBLE) AS lift
  FROM r JOIN s1 x ON x.item = a JOIN s1 y ON y.item = c, t WHERE r.n / x.n::DOUBLE >= 0.1 AND (r.n / x.n::DOUBLE) / (y.n / t.n::DOUBLE) > 1)
SELECT row_number() OVER (ORDER BY floor(confidence * 1000 + 0.5) DESC, floor(support * 1000 + 0.5) DESC, floor(lift * 100 + 0.5) DESC, antecedent, consequent) AS place,
  antecedent, consequent, n, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift FROM q""")
def g14(spark: SparkSession, d: str) -> DataFrame:
    rows = baskets(spark, d)
    n = rows.select("basket").distinct().count()
    found = G.numbered(M.rules(M.itemsets(rows, "basket", "item", 0.02), n, 0.1), M.rule_order(), "place")
    return found.select((F.col("place") + 1).alias("place"), "antecedent", "consequent", "n", *[F.round(c, 9).alias(c) for c in ("support", "confidence", "lift")])


@query("g15_jaccard", f"""
WITH {BASKETS}, s AS (SELECT item, count(*) AS n FROM b GROUP BY 1), p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)
SELECT a, b, 1 - p.n / (x.n + y.n - p.n)::DOUBLE AS distance FROM p JOIN s x ON x.item = a JOIN s y ON y.item = b""")
def g15(spark: SparkSession, d: str) -> DataFrame:
    return M.jaccard_distances(baskets(spark, d), "basket", "item")


@query("g26_evidence", """
WITH e AS (SELECT item_id, text, CASE WHEN item_id % 7 = 0 THEN NULL WHEN item_id % 5 = 0 THEN 1000000 ELSE item_id END AS pid FROM benchmark)
SELECT CASE WHEN pid IS NULL THEN 'no_passage_id' WHEN d.doc_id IS NULL THEN 'passage_unresolved' WHEN contains(d.text, e.text) THEN 'found' ELSE 'not_found' END AS evidence, count(*) AS n
FROM e LEFT JOIN documents d ON d.doc_id = pid GROUP BY 1""")
def g26(spark: SparkSession, d: str) -> DataFrame:
    pid = F.when(F.col("item_id") % 7 == 0, None).when(F.col("item_id") % 5 == 0, 1_000_000).otherwise(F.col("item_id"))
    edges = table(spark, d, "benchmark").select(F.col("text").alias("source_sentence"), pid.cast("string").alias("passage_id"))
    passages = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pid"), "text")
    return Q.evidence(edges, passages).groupBy("evidence").agg(F.count("*").alias("n"))


@query("d05_record_numbers", """
SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9.]+'), lambda x: regexp_full_match(x, '[0-9]{7,8}'))) AS n FROM documents WHERE len(list_filter(regexp_extract_all(text, '[0-9.]+'), lambda x: regexp_full_match(x, '[0-9]{7,8}'))) > 0""")
def d05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(RECORD[0])).alias("n")).where("n > 0")


@query("x05_text_window", """
SELECT doc_id, substr(text, greatest(1, instr(text, 'token') - 80), instr(text, 'token') + 5 + 80 - greatest(1, instr(text, 'token') - 80)) AS around FROM documents WHERE contains(text, 'token')""")
def x05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.around(F.col("text"), "token").alias("around")).where("around is not null")


@query("x13_first_rule", """
SELECT doc_id, CASE WHEN regexp_matches(text, 'licen[cs]e') THEN 'license' WHEN regexp_matches(text, '[0-9]{7,}') THEN 'number' WHEN regexp_matches(text, '[é]') THEN 'accent' ELSE 'other' END AS type,
  CASE WHEN regexp_matches(text, 'licen[cs]e') THEN regexp_extract(text, 'licen[cs]e') WHEN regexp_matches(text, '[0-9]{7,}') THEN regexp_extract(text, '[0-9]{7,}') WHEN regexp_matches(text, '[é]') THEN 'é' ELSE '' END AS match FROM documents""")
def x13(spark: SparkSession, d: str) -> DataFrame:
    rules = [("license", "licen[cs]e"), ("number", "[0-9]{7,}"), ("accent", "[é]")]
    return table(spark, d, "documents").select("doc_id", X.classified(F.col("text"), rules, "other").alias("c")).select("doc_id", "c.*")


@query("x14_all_rules", """
SELECT doc_id, list_filter([CASE WHEN contains(text, 'license') THEN 'license' END, CASE WHEN regexp_matches(text, '[0-9]{7,}') THEN 'number' END, CASE WHEN contains(text, 'é') THEN 'accent' END], lambda x: x IS NOT NULL) AS tags FROM documents""")
def x14(spark: SparkSession, d: str) -> DataFrame:
    rules = [("license", "license"), ("number", "[0-9]{7,}"), ("accent", "é")]
    return table(spark, d, "documents").select("doc_id", X.tagged(F.col("text"), rules).alias("tags"))


@query("p01_json_attributes", """
SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("s02_scripts_in_html", """
SELECT page_id, regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS script FROM pages""")
def s02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", script_of(F.col("html")).alias("script"))


@query("k04_triple_counts", f"""
WITH {VIEWS} SELECT p, count(*) AS n FROM (SELECT 'a' AS p FROM n UNION ALL SELECT 'name' FROM n UNION ALL SELECT type FROM e UNION ALL SELECT 'n_regionkey' FROM nation
UNION ALL SELECT unnest(['c_nationkey', 'c_acctbal', 'c_mktsegment']) FROM customer UNION ALL SELECT unnest(['s_nationkey', 's_acctbal']) FROM supplier
UNION ALL SELECT unnest(['p_brand', 'p_type', 'p_size', 'p_retailprice']) FROM part UNION ALL SELECT unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) FROM orders) GROUP BY p""")
def k04(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.triples import triples

    return triples(star_graph(spark, d)).groupBy("p").agg(F.count("*").alias("n"))
