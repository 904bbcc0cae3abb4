"""Study-shaped queries: profiles with shares, timelines, evidence chains, triage, sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.privacy import string_leaves
from ..operators import cohort as C
from ..operators import mining as M
from ..operators import pattern as P
from ..operators import stats as S
from ..operators.phrases import quoted
from ..sources.testdata import star_graph, table
from .analytics import BASKETS, VIEWS, baskets, quantities
from .registry import query


@query("a26_leaders_with_share", """
WITH c AS (SELECT p_type AS type, p_brand AS item, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT type, item, n, round(100.0 * n / sum(n) OVER (PARTITION BY type), 1) AS share, row_number() OVER (PARTITION BY type ORDER BY n DESC, item) AS rank FROM c QUALIFY rank <= 8""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    counts = quantities(spark, d).groupBy(F.col("p_type").alias("type"), F.col("brand").alias("item")).agg(F.count("*").alias("n"))
    shared = counts.withColumn("share", S.percent(F.col("n"), F.sum("n").over(Window.partitionBy("type"))))
    return P.top_per_group(shared, 8, ["type"], F.desc("n"), F.asc("item"))


@query("a32_similarity_within_groups", f"""
WITH {BASKETS}, s AS (SELECT item, count(*) AS n FROM b GROUP BY 1), p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)
SELECT right(a, 1) AS grp, count(*) AS pairs, round(avg(p.n / (x.n + y.n - p.n)::DOUBLE), 9) AS similarity FROM p JOIN s x ON x.item = a JOIN s y ON y.item = b WHERE right(a, 1) = right(b, 1) GROUP BY 1""")
def a32(spark: SparkSession, d: str) -> DataFrame:
    near = M.jaccard_distances(baskets(spark, d), "basket", "item")
    own = near.withColumn("grp", F.substring("a", -1, 1)).where(F.col("grp") == F.substring("b", -1, 1))
    return own.groupBy("grp").agg(F.count("*").alias("pairs"), F.round(F.avg(1 - F.col("distance")), 9).alias("similarity"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """id, first and last year and degree of every customer with two orders or more, in any order."""
    told = table(spark, d, "orders").select("o_custkey", X.year(F.date_format("o_orderdate", "yyyy")).alias("y"))
    rows = told.where("y.year is not null").groupBy(F.col("o_custkey").alias("id")).agg(F.min("y.year").alias("first"), F.max("y.year").alias("last"), F.count("*").alias("degree"))
    return rows.where("degree >= 2")


@query("a43_timeline", """
WITH y AS (SELECT o_custkey, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last, count(*) AS degree FROM orders GROUP BY 1)
SELECT o_custkey AS id, first, last, degree FROM y WHERE degree >= 2 ORDER BY first, last, id""")
def a43(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d).orderBy("first", "last", "id")


def evidence(spark: SparkSession, d: str, lines: DataFrame) -> DataFrame:
    """The line of largest quantity of each order, with the names of its part and supplier."""
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    best = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.max_by(F.struct("l_linenumber", "p_partkey", "s_suppkey"), F.struct("l_quantity", "l_linenumber", "p_partkey", "s_suppkey")).alias("b")).select("id", "b.*")
    named = best.join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return named.select("id", F.col("l_linenumber").alias("line"), F.col("p_name").alias("part"), F.col("s_name").alias("supplier"))


@query("g21_evidence_chain", """
SELECT l_orderkey AS id, arg_max(l_linenumber, (l_quantity, l_linenumber, l_partkey, l_suppkey)) AS line, arg_max(p_name, (l_quantity, l_linenumber, l_partkey, l_suppkey)) AS part, arg_max(s_name, (l_quantity, l_linenumber, l_partkey, l_suppkey)) AS supplier
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def g21(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d, table(spark, d, "lineitem"))


@query("g22_usage_features", """
SELECT f AS feature, count(*) AS cases, sum(n)::BIGINT AS occurrences, min(doc_id) AS example FROM (
  SELECT doc_id, unnest([{'f': 'number', 'n': len(regexp_extract_all(text, '[0-9]{4,}'))}, {'f': 'license', 'n': len(regexp_extract_all(text, '[Ll]icen[cs]e'))}, {'f': 'sign', 'n': len(regexp_extract_all(text, '[%&$#]{3}'))}], recursive := true) FROM documents) WHERE n > 0 GROUP BY 1""")
def g22(spark: SparkSession, d: str) -> DataFrame:
    patterns = {"number": "[0-9]{4,}", "license": "[Ll]icen[cs]e", "sign": "[%&$#]{3}"}
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in patterns.items()]))
    rows = table(spark, d, "documents").select("doc_id", told.alias("t")).select("doc_id", "t.*").where("n > 0")
    return rows.groupBy("feature").agg(F.count("*").alias("cases"), F.sum("n").alias("occurrences"), F.min("doc_id").alias("example"))


@query("g23_quotes_verified", """
SELECT item_id AS item, doc_id AS passage FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def g23(spark: SparkSession, d: str) -> DataFrame:
    return quoted(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text").select(F.col("item_id").alias("item"), F.col("text_id").alias("passage"))


@query("g24_triage", """
WITH x AS (SELECT doc_id, source, text, substr(text, greatest(1, instr(text, 'license') - 80), instr(text, 'license') + 7 + 80 - greatest(1, instr(text, 'license') - 80)) AS w FROM documents WHERE contains(text, 'license'))
SELECT doc_id, CASE WHEN source IN ('src3', 'src7') THEN 'excluded' WHEN contains(text, 'licensed under the GNU') THEN 'direct' WHEN contains(w, 'Apache') THEN 'window' ELSE 'default' END AS verdict FROM x""")
def g24(spark: SparkSession, d: str) -> DataFrame:
    excluded = spark.createDataFrame([("src3", "known artefact"), ("src7", "known artefact")], "source string, reason string")
    rows = table(spark, d, "documents").where(F.col("text").contains("license")).join(F.broadcast(excluded), "source", "left")
    verdict = (
        F.when(F.col("reason").isNotNull(), "excluded").when(F.col("text").contains("licensed under the GNU"), "direct")
        .when(X.around(F.col("text"), "license").contains("Apache"), "window").otherwise("default")
    )
    return rows.select("doc_id", verdict.alias("verdict"))


@query("g25_sensitivity", """
WITH f AS (SELECT p_brand AS item, count(DISTINCT o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS narrow, count(DISTINCT o_orderkey) AS broad
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY narrow DESC, item) AS rn, row_number() OVER (ORDER BY broad DESC, item) AS rb FROM f)
SELECT count(*) FILTER (rn <= 20 AND rb <= 20) AS overlap, count(*) FILTER (rn <= 20) AS leading FROM r""")
def g25(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("basket"), (F.col("o_orderpriority") == "1-URGENT").alias("inner"))
    counts = baskets(spark, d).join(orders, "basket").groupBy("item").agg(F.count_if("inner").alias("narrow"), F.count("*").alias("broad"))
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "item"))
    ranked = counts.withColumn("rn", place("narrow")).withColumn("rb", place("broad"))
    return ranked.agg(F.count_if((F.col("rn") <= 20) & (F.col("rb") <= 20)).alias("overlap"), F.count_if(F.col("rn") <= 20).alias("leading"))


@query("f08_cohorts", """
WITH l AS (SELECT l_orderkey, bool_or(regexp_matches(p_brand, '(URGENT|#1|07)$')) AS d, bool_or(regexp_matches(s_name, '(URGENT|#1|07)$')) AS s, bool_or(l_returnflag = 'R') AS u
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
f AS (SELECT o_orderkey AS id, regexp_matches(o_orderpriority, '(URGENT|#1|07)$') OR coalesce(d, false) AS named, coalesce(s, false) AS s, coalesce(u, false) AS u FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT id, named AS candidate, named AND u AS included, named AND NOT u AS excluded, (named OR s) AND u AS extended FROM f""")
def f08(spark: SparkSession, d: str) -> DataFrame:
    part, supplier = table(spark, d, "part").select("p_partkey", "p_brand"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    told = lines.join(part, "p_partkey").join(supplier, "s_suppkey").groupBy("l_orderkey").agg(
        F.collect_set("p_brand").alias("diagnoses"), F.collect_set("s_name").alias("symptoms"), F.bool_or(F.col("l_returnflag") == "R").alias("used")
    )
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")).join(told.withColumnRenamed("l_orderkey", "id"), "id", "left")
    return C.cohort(cases, "(URGENT|#1|07)$").select("id", "candidate", "included", "excluded", "extended")


@query("f09_without_artefacts", """
SELECT doc_id FROM documents WHERE NOT coalesce(source = 'src1' AND contains(text, 'license'), false) AND NOT coalesce(source = 'src2' AND contains(text, 'token'), false)""")
def f09(spark: SparkSession, d: str) -> DataFrame:
    return C.without_artefacts(table(spark, d, "documents"), "source", "text", [("src1", "license"), ("src2", "token")]).select("doc_id")


KNOWN_BRANDS = "v AS (SELECT * FROM (VALUES ('Brand#1', 'a'), ('Brand#2', 'b'), ('Brand#3', 'a'), ('Brand#99', 'c')) t(brand, kind)), c AS (SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


def known_brands(spark: SparkSession, d: str) -> DataFrame:
    counts = quantities(spark, d).groupBy("brand").agg(F.count("*").alias("n"))
    return C.looked_up(counts, spark.createDataFrame([("Brand#1", "a"), ("Brand#2", "b"), ("Brand#3", "a"), ("Brand#99", "c")], "brand string, kind string"), "brand")


@query("a22_coverage", f"""
WITH {KNOWN_BRANDS} SELECT count(*) AS keys, count(kind) AS known_keys, sum(n)::BIGINT AS uses, coalesce(sum(n) FILTER (kind IS NOT NULL), 0)::BIGINT AS covered,
  round(100.0 * coalesce(sum(n) FILTER (kind IS NOT NULL), 0) / sum(n), 1) AS share FROM c LEFT JOIN v USING (brand)""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage(known_brands(spark, d))


@query("j19_unknown_keys", f"WITH {KNOWN_BRANDS} SELECT brand, n FROM c WHERE brand NOT IN (SELECT brand FROM v)")
def j19(spark: SparkSession, d: str) -> DataFrame:
    return known_brands(spark, d).where("not known").select("brand", "n")


@query("a29_degree_summary", f"""
WITH {VIEWS}, x AS (SELECT s AS id FROM e UNION ALL SELECT o FROM e), g AS (SELECT id, count(*) AS degree FROM x GROUP BY id)
SELECT count(*) AS n, median(degree)::DOUBLE AS median, max(degree) AS greatest FROM g""")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return S.degree_summary(P.degree(star_graph(spark, d).edges, "n_support"), "degree")


@query("x30_string_leaves", """
SELECT o_orderkey::VARCHAR AS id, [o_orderstatus, o_orderpriority, o_orderstatus, o_orderpriority] AS leaves FROM orders""")
def x30(spark: SparkSession, d: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    records = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), F.struct(F.lit("p1").alias("pid"), priority.alias("name"), F.lit("").alias("note")).alias("info"),
        F.array(F.struct(status.alias("s"), F.lit(3).alias("n"))).alias("items"), F.create_map(F.lit("passage_id"), F.lit("p2"), F.lit("k"), priority).alias("more"),
    )
    return records.select("id", string_leaves(records).alias("leaves"))
