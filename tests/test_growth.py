"""What a task holds and a plan shuffles mustn't grow with the tables: shapes of plans, and results on odd rows beside plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from strandgraph.model import Graph
from strandgraph.operators import graph as G
from strandgraph.operators import mining as M
from strandgraph.operators import pattern as P
from strandgraph.operators import quality as Q
from strandgraph.operators import release as R
from strandgraph.operators import stats as S
from strandgraph.operators.triples import triples
from strandgraph.plans import catalogue, registry
from strandgraph.sources.testdata import star_graph

from .oracle import TABLES, connection, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ties_of_the_inventory_are_settled(spark, tmp_path):
    for name, sql in {
        "part": "select range p_partkey, 'same' p_name, 'b' p_brand, 't' p_type, 3 p_size, 1.0::double p_retailprice from range(200)",
        "supplier": "select range s_suppkey, 's' || lpad((999 - range)::varchar, 3, '0') s_name, 0 s_nationkey, 0.0::double s_acctbal from range(200)",
        "lineitem": "select range l_orderkey, range l_partkey, range l_suppkey, 1 l_linenumber, 50.0::double l_quantity from range(200)",
    }.items():
        connection(SF).execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
    for name in ("region", "nation", "customer", "orders"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    got = [r["suppliers"] for r in registry.QUERIES["q08_inventory_with_optional_targets"](spark, str(tmp_path)).collect()]
    assert got == [[f"s{999 - k:03d}"] for k in range(199, 149, -1)]


def test_parts_without_a_name_come_last_in_the_inventory(spark, tmp_path):
    parts = "select range p_partkey, case when range % 10 > 0 then 'p' || lpad(range::varchar, 2, '0') end p_name, 'b' p_brand, 't' p_type, 3 p_size, 1.0::double p_retailprice from range(60)"
    connection(SF).execute(f"copy ({parts}) to '{tmp_path}/part.parquet' (format parquet)")
    for name in TABLES:
        if name != "part":
            (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    name = "q08_inventory_with_optional_targets"
    got = spark_rows(registry.QUERIES[name](spark, str(tmp_path)))
    assert got == sql_rows(connection(tmp_path), registry.SQL[name])


@pytest.mark.parametrize("few", [0, 100])
def test_audit_beside_a_plain_loop(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW_ENDS", few)
    rng = random.Random(5)
    nodes = {f"n{i}": rng.choice(["A", "B", None]) for i in range(40)}
    ends = [*nodes, "gone1", "gone2", None]
    edges = [(rng.choice(["r", "s", "u", None]), rng.choice(ends), rng.choice(ends), rng.choice(["x", "y"])) for _ in range(60)] * 2 + [("r", "n1", "n1", "x")]
    ontology = {"r": ("A", "B", "0..1"), "s": ("B", "A", "0..*")}
    want = Counter()
    for t, s, o, layer in edges:
        want["edges", t] += 1
        want["layer", layer] += 1
        a, b = nodes.get(s), nodes.get(o)
        if a is None or b is None:
            want["integrity", "dangling"] += 1
            continue
        want["integrity", "self_loop"] += s == o
        want["integrity", "undeclared"] += t not in ontology
        want["integrity", "domain"] += t in ontology and ontology[t][0] != a
        want["integrity", "range"] += t in ontology and ontology[t][1] != b
    for (t, s, o), n in Counter(e[:3] for e in edges).items():
        want["integrity", "duplicate"] += n - 1 if nodes.get(s) is not None and nodes.get(o) is not None else 0
    for i, c in nodes.items():
        want["nodes", c] += 1
        if not any(i in e[1:3] for e in edges):
            want["isolates", c] += 1
    others = defaultdict(set)
    for t, s, o, _ in edges:
        if t == "r":
            others[s].add(o)
    want["cardinality", "r"] = sum(len(x - {None}) > 1 for x in others.values())
    graph = Graph(
        spark.createDataFrame([(i, c, i) for i, c in nodes.items()], "id string, cls string, name string"),
        spark.createDataFrame(edges, "type string, subject_id string, object_id string, layer string"),
    )
    rows = Q.audit(graph, spark.createDataFrame([(t, *x) for t, x in ontology.items()], "type string, domain string, range string, card string"))
    got = {(r["metric"], r["key"]): r["value"] for r in rows.collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_edges_made_once_are_not_folded_again(spark):
    graph = star_graph(spark, SF)
    assert "concat" not in "".join(x for x in plan(triples(graph).groupBy("p").count()).splitlines() if "Aggregate" in x and "concat(order:" in x)
    pair = Graph(spark.createDataFrame([("a", "A", "a", None)], "id string, cls string, name string, attrs map<string,string>"), spark.createDataFrame([("r", "a", "a")] * 2, "type string, subject_id string, object_id string"))
    assert triples(pair).where("p = 'r'").count() == 1


def test_isolates_need_no_grouped_edges(spark):
    graph = star_graph(spark, SF)
    rows = P.isolates(graph.of("order"), graph.typed("orderHasPart"))
    assert plan(rows).count("Aggregate") == 2
    assert graph.typed("nationInRegion", "supplierInNation").count() == graph.edges.where("type in ('nationInRegion', 'supplierInNation')").count()
    assert graph.typed("none").count() == 0


def test_contingency_groups_members_twice(spark):
    members = spark.createDataFrame([("u1", "i", "c"), ("u1", "i", "c"), ("u1", "j", "c"), ("u2", None, "d"), ("u3", "i", "d")], "u string, i string, c string")
    cells = S.contingency(members, "i", "c", "u")
    assert "LogicalRDD" in plan(cells) and plan(cells).count("Aggregate") <= 6
    assert {(r["i"], r["c"]): (r["a"], r["b"], r["c"], r["d"])[:2] for r in cells.collect()} == {("i", "c"): (1, 1), ("i", "d"): (1, 1), ("j", "c"): (1, 0), ("j", "d"): (0, 1)}
    assert G.dealt(members, 10 * G.TASK_ROWS, "u").rdd.getNumPartitions() == 10


def test_statements_meet_without_joins(spark):
    edges = spark.createDataFrame([("a", "r", "b", 1), ("a", "r", "b", 1), ("a", "r", "b", 2), ("a", "s", "b", 3), ("a", "r", None, 4), ("c", "r", "d", None)], "subject_id string, type string, object_id string, n_support long")
    rows = catalogue.provenance(edges)
    assert "Join" not in plan(rows)
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "b", 1), ("a", "b", 2), ("a", "b", 3)]


def test_case_records_are_dealt_by_case(spark):
    nodes = spark.createDataFrame([("k", "C", "k"), ("l", "C", "l"), ("a", "A", "a"), ("b", "A", "b"), ("z", "A", None)], "id string, cls string, name string")
    edges = spark.createDataFrame([("k", "b", "r", 1), ("k", "a", "r", 2), ("k", "b", "r", 3), ("k", "a", "s", 0), ("k", "z", "s", 1), ("k", "a", "t", 0), ("k", "gone", "r", 0)], "subject_id string, object_id string, type string, ordinal int")
    rows = R.case_records(Graph(nodes, edges), ["r", "s"], "C")
    assert "RepartitionByExpression" in plan(rows)
    assert {tuple(map(str, r)) for r in rows.collect()} == {("k", "['b', 'a']", "['a', None]"), ("l", "[]", "[]")}


def test_last_level_of_itemsets_is_not_written(spark, monkeypatch):
    put, names = G.Rounds.put, []
    monkeypatch.setattr(G.Rounds, "put", lambda self, name, rows: names.append(name) or put(self, name, rows))
    members = spark.createDataFrame([(b, x) for b, xs in [(1, "abc"), (2, "abc"), (3, "ab")] for x in xs], "basket int, item string")
    sets = {("".join(r["items"]), r["n"]) for r in M.itemsets(members, "basket", "item", 0.5).collect()}
    assert sets == {("a", 3), ("b", 3), ("c", 2), ("ab", 3), ("ac", 2), ("bc", 2), ("abc", 2)}
    assert names.count("held") == 1 and "grown" not in names


def test_first_items_are_ranked_not_gathered(spark):
    rows = spark.createDataFrame([("g", x) for x in "dcbaab"] + [("g", None), ("h", None), (None, "x")], "g string, x string")
    got = P.counted_with_first(rows, "g", "x", 3, "first")
    assert {r["g"]: (r["n"], r["first"]) for r in got.collect()} == {"g": (7, ["a", "b", "c"]), "h": (1, []), None: (1, ["x"])}
    made = registry.QUERIES["q12_by_attribute"](spark, SF)
    assert "collect_set" not in plan(made)
