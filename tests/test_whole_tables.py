import math

from strandgraph.operators import stats as S
from strandgraph.plans import analytics, catalogue, registry, studies  # noqa: F401
from strandgraph.sources.testdata import star_graph, table

from .oracle import TABLES, connection, spark_rows, sql_rows

SF = "/root/testdata/sf0.01"


def rows(spark, name):
    return registry.QUERIES[name](spark, SF)


def test_no_id_range_is_left_out(spark):
    lines, orders = table(spark, SF, "lineitem"), table(spark, SF, "orders")
    assert rows(spark, "w02_positional_join").count() == lines.count()
    assert rows(spark, "g21_evidence_chain").count() == lines.select("l_orderkey").distinct().count()
    urgent = lines.join(orders.where("o_orderpriority = '1-URGENT'"), lines["l_orderkey"] == orders["o_orderkey"])
    assert rows(spark, "sparql2_statements_with_provenance").count() == urgent.select("l_orderkey", "l_partkey").distinct().count()


def test_next_line_of_the_same_part(spark):
    lines = spark.createDataFrame([(9000, 7, 1), (9000, 8, 2), (9000, 7, 3), (9000, 7, 6), (9001, 7, 1)], "l_orderkey long, l_partkey long, l_linenumber int")
    assert {tuple(r) for r in analytics.followed(lines).collect()} == {(9000, 1, 3), (9000, 3, 6), (9000, 6, None), (9000, 2, None), (9001, 1, None)}


def test_every_row_of_degree_and_timeline(spark):
    edges = star_graph(spark, SF).edges
    assert rows(spark, "a07_degree").count() == edges.select("subject_id").union(edges.select("object_id")).distinct().count()
    assert rows(spark, "a43_timeline").count() == table(spark, SF, "orders").groupBy("o_custkey").count().where("count >= 2").count()


def test_lift_comes_with_the_exact_test_and_its_q(spark):
    got = [r.asDict() for r in registry.QUERIES["a31_lift_and_fisher_q"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == 125
    for r in got:
        a, row, col, n = r["a"], r["a"] + r["b"], r["a"] + r["c"], r["a"] + r["b"] + r["c"] + r["d"]
        r["exact"] = sum(math.comb(row, k) * math.comb(n - row, col - k) for k in range(a, min(row, col) + 1)) / math.comb(n, col)
        assert math.isclose(r["p"], r["exact"], abs_tol=1e-8) and math.isclose(r["lift"], a * n / (row * col))
    q = 1.0
    for rank, r in sorted(enumerate(sorted(got, key=lambda r: r["exact"]), 1), reverse=True):
        q = min(q, r["exact"] * len(got) / rank)
        assert math.isclose(r["q"], q, abs_tol=1e-8)


def test_exact_test_at_millions_of_units(spark):
    cells = [(450_000, 1_800_000, 1_350_000, 5_400_000), (450_700, 1_799_300, 1_349_300, 5_400_700), (449_300, 1_800_700, 1_350_700, 5_399_300), (3, 2_000_000, 2, 7_000_000)]
    rows = spark.createDataFrame(cells, "a long, b long, c long, d long").select("a", "b", "c", "d", S.fisher_greater("a", "b", "c", "d").alias("p"))
    for a, b, c, d, p in rows.collect():
        row, col, n = a + b, a + c, a + b + c + d

        def beside(step, row=row, col=col, n=n, a=a):
            # Chances from a on, as parts of that of a: ratios of neighbours, no factorials.
            k, term, total = a, 1.0, 0.0
            while term > 1e-18 * total:
                ratio = (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1)) if step > 0 else k * (n - row - col + k) / ((row - k + 1) * (col - k + 1))
                k, term = k + step, term * ratio
                total += term
            return total

        up = 1 + beside(1)
        assert math.isclose(p, up / (up + beside(-1)), rel_tol=1e-10)


def test_isolates_of_every_kind_at_every_edge(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    changed = {
        "region": "select * from region union all select 90, 'EMPTY' union all select 91, null",
        "part": "select * from part union all select range + 1000000, 'lone', 'b', 't', 1, 1.0 from range(3)",
        "customer": "select * from customer union all select null, 'no key', 1, 0.0, 's'",
        "lineitem": "select * replace (nullif(l_partkey, 7) as l_partkey) from lineitem where l_orderkey % 2 = 0",
    }
    for name in TABLES:
        if name in changed:
            connection(small).execute(f"copy ({changed[name]}) to '{tmp_path}/{name}.parquet' (format parquet)")
        else:
            (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    made = registry.QUERIES["q25_isolates_per_kind"](spark, str(tmp_path))
    got = {r["cls"]: r["n"] for r in made.collect()}
    lines = connection(tmp_path).execute("select count(*) from part where p_partkey not in (select l_partkey from lineitem where l_partkey is not null)").fetchone()[0]
    assert got == {"region": 2, "nation": 0, "customer": 1, "supplier": 0, "part": lines, "order": 0} and lines >= 4
    assert spark_rows(made) == sql_rows(connection(tmp_path), registry.SQL["q25_isolates_per_kind"])
