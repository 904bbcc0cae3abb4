import math
import random

import pytest
from pyspark.sql import functions as F
from strandgraph.model import Graph
from strandgraph.operators import graph as G
from strandgraph.operators import mining as M
from strandgraph.operators import pattern as P
from strandgraph.operators import quality as Q
from strandgraph.operators import release as R
from strandgraph.operators import stats as S
from strandgraph.sources import readers, writers

NODES = [(f"n{i}", "A" if i < 6 else "B", f"name{i}") for i in range(12)]
# n10, n11: isolates; ghost: dangling; n0-n0: self-loop; n0-n6 r twice; n6-n0 r breaks domain and range; t: undeclared.
EDGES = [
    ("r", "n0", "n6"), ("r", "n0", "n6"), ("r", "n1", "n7"), ("r", "n1", "n8"), ("r", "n6", "n0"), ("r", "n2", "ghost"), ("s", "n0", "n0"), ("t", "n3", "n4"), ("s", "n4", "n5"), ("s", "n2", "n3"), ("r", "n9", "n9"),
]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(NODES, "id string, cls string, name string").withColumn("attrs", F.create_map(F.lit("k"), F.col("name")))
    edges = spark.createDataFrame(EDGES, "type string, subject_id string, object_id string").withColumns({"n_support": F.lit(1), "layer": F.lit("x")})
    return Graph(nodes, edges)


@pytest.fixture(scope="module")
def ontology(spark):
    return spark.createDataFrame([("r", "A", "B", "0..1"), ("s", "A", "A", "0..*")], "type string, domain string, range string, card string")


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    ordered = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return {n: (i, len(g)) for i, g in enumerate(ordered) for n in g}


def test_components(graph):
    got = {r["id"]: (r["component"], r["size"]) for r in G.components(graph).collect()}
    assert got == brute_components([n[0] for n in NODES], [e[1:] for e in EDGES])


def test_components_of_chains_and_random_graphs(spark):
    rng = random.Random(3)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    loose = [(f"x{rng.randrange(80):02d}", f"x{rng.randrange(80):02d}") for _ in range(50)]
    ids = sorted({x for e in chain + loose for x in e} | {"alone"})
    nodes = spark.createDataFrame([(i, "A", i) for i in ids], "id string, cls string, name string")
    for parts in (1, 7):
        edges = spark.createDataFrame([("r", a, b) for a, b in chain + loose], "type string, subject_id string, object_id string").repartition(parts)
        got = {r["id"]: (r["component"], r["size"]) for r in G.components(Graph(nodes, edges)).collect()}
        assert got == brute_components(ids, chain + loose)


def test_validate(graph, ontology):
    got = {r["check"]: r["n"] for r in Q.validate(graph, ontology).collect()}
    assert got == {"dangling": 1, "self_loop": 2, "undeclared": 1, "domain": 2, "range": 1, "duplicate": 1}
    cards = {r["type"]: (r["by_rows"], r["by_objects"]) for r in Q.cardinality_exceptions(graph.edges, ontology).collect()}
    assert cards == {"r": (2, 1)}


def test_evidence(spark):
    edges = spark.createDataFrame(
        [("p1", "a / b"), ("p1", "a / z"), ("p9", "a"), (None, "a"), ("", "a"), ("p1", None), ("p2", "ＡＢ")], "passage_id string, source_sentence string"
    ).withColumn("evidence_in_passage", F.lit(None).cast("boolean"))
    passages = spark.createDataFrame([("p1", "xaxb"), ("p2", "A B")], "pid string, text string")
    got = sorted((r["evidence"], r["evidence_in_passage"]) for r in Q.evidence(edges, passages).collect())
    assert [x[0] for x in got] == ["found", "no_passage_id", "no_passage_id", "no_sentence", "not_found", "not_found", "passage_unresolved"]
    normal = Q.evidence(edges, passages, normal=True)
    assert normal.where("evidence = 'found'").count() == 2


def test_patterns(graph):
    assert {r["id"] for r in P.isolates(graph.nodes, graph.edges).collect()} == {"n10", "n11"}
    assert P.known_edges(graph.edges, graph.nodes).count() == len(EDGES) - 1
    degrees = {r["id"]: r["degree"] for r in P.degree(graph.edges).collect()}
    assert degrees["n0"] == 5 and degrees["n9"] == 2
    assert {r["id"] for r in P.search_nodes(graph.nodes, "NAME11").collect()} == {"n11"}
    assert P.neighbourhood(graph, "n4").count() == 2
    assert P.filter_edges(graph.edges, type="s", layer=None).count() == 3


def test_preview_and_modularity(spark, graph):
    small = G.preview(graph, {"B": 1}, default=2, k=3)
    assert small.nodes.count() == 3
    square = [("a", "b", 1), ("c", "d", 1), ("b", "c", 1)]
    edges = spark.createDataFrame(square, "a string, b string, w int")
    member = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "id string, community int")
    q = G.modularity(edges, member).first()["q"]
    assert math.isclose(q, 2 * (1 / 3 - 0.25))
    labels = {r["id"]: r["community"] for r in G.communities(spark.createDataFrame([(a, b, 9) for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"))] + [("c", "x", 1)], "a string, b string, w int")).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["x"] == labels["y"] == labels["z"]


def test_rules_with_two_consequents(spark):
    baskets = [("1", "abc"), ("2", "abc"), ("3", "ab"), ("4", "c"), ("5", "d")]
    members = spark.createDataFrame([(b, x) for b, xs in baskets for x in xs], "basket string, item string")
    sets = M.itemsets(members, "basket", "item", 0.4)
    assert {("".join(r["items"]), r["n"]) for r in sets.collect()} == {("a", 3), ("b", 3), ("c", 3), ("ab", 3), ("ac", 2), ("bc", 2), ("abc", 2)}
    rules = {("".join(r["antecedent"]), "".join(r["consequent"])): (r["n"], round(r["confidence"], 4), round(r["lift"], 4)) for r in M.rules(sets, 5, 0.6).collect()}
    assert rules[("a", "bc")] == (2, 0.6667, 1.6667) and rules[("ab", "c")] == (2, 0.6667, 1.1111) and ("a", "b") in rules


def test_statistics(spark):
    rows = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 10)] + [("h", 1.0)], "g string, x double")
    q = S.exclusive_quartiles(rows, ["g"], "x").collect()
    assert [(r["q1"], r["q2"], r["q3"]) for r in q] == [(1.25, 2.5, 8.25)]
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double")
    adjusted = {r["k"]: round(r["q"], 6) for r in S.adjusted(p, "p", "k").collect()}
    assert adjusted == {"a": 0.04, "b": 0.053333, "c": 0.053333, "d": 0.5}
    cells = spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int")
    assert math.isclose(cells.select(S.fisher_greater("a", "b", "c", "d").alias("p")).first()["p"], 17 / 70)
    both = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 4)], "x int, y int")
    assert math.isclose(S.spearman(both, "x", "y").first()["rho"], 0.8)
    assert {r["g"]: r["modes"] for r in S.modes(rows, ["g"], "x").collect()} == {"g": [1.0, 2.0, 3.0, 10.0], "h": [1.0]}


def test_round_trip(spark, graph, tmp_path):
    full = Graph(graph.nodes.where("id <> 'n11'").withColumns({"aliases": F.array(F.lit("x"), F.lit('q"uote')), "n_mentions": F.lit(2)}), graph.edges.withColumn("evidence_in_passage", F.lit(None).cast("boolean")).withColumn("source_sentence", F.lit('a "b"\nc')))
    writers.write_graph_csv(full, str(tmp_path), writers.observed_attributes(full.nodes))
    back = readers.read_csv_graph(spark, f"{tmp_path}/nodes", f"{tmp_path}/edges")
    node = back.nodes.where("id = 'n1'").first()
    assert (node["name"], node["aliases"], node["attrs"], node["n_mentions"]) == ("name1", ["x", 'q"uote'], {"k": "name1"}, 2)
    assert back.edges.count() == len(set(EDGES)) - 1
    edge = back.edges.first()
    assert edge["source_sentence"] == 'a "b"\nc' and edge["evidence_in_passage"] is None
    writers.write_graph_lines(full, f"{tmp_path}/lines")
    assert readers.read_graph_lines(spark, f"{tmp_path}/lines/nodes", f"{tmp_path}/lines/edges").edges.count() == len(EDGES)
    n = writers.write_turtle(full, f"{tmp_path}/ttl")
    assert n == 11 * 3 + len(set(EDGES)) + 3 * len(set(EDGES))


def test_readers(spark, tmp_path):
    (tmp_path / "page.html").write_text('<html><script type="application/json">{"a": 1}</script></html>')
    (tmp_path / "plain.json").write_text('{"a": 2}')
    assert sorted(r["a"] for r in readers.read_embedded_json(spark, f"{tmp_path}/*.*", "a int").collect()) == [1, 2]
    (tmp_path / "one.json").write_text('{"passages": [{"pid": "a", "source": "s", "text": "old"}, {"id": "b", "source": "s", "text": "bb"}]}')
    (tmp_path / "two.json").write_text('{"passages": [{"pid": "a", "source": "s", "text": "new"}]}')
    got = readers.read_passages(spark, [f"{tmp_path}/one.json", f"{tmp_path}/gone.json", f"{tmp_path}/two.json"])
    assert {(r["pid"], r["text"], r["n_chars"]) for r in got.collect()} == {("a", "new", 3), ("b", "bb", 2)}
    (tmp_path / "layout.json").write_text('{"a": [1.5, 2.0]}')
    assert [tuple(r) for r in readers.read_layout(spark, f"{tmp_path}/layout.json").collect()] == [("a", 1.5, 2.0)]
    nodes, engines = readers.read_previous(spark, f"{tmp_path}/none.json", "x")
    assert nodes.count() == engines.count() == 0
    (tmp_path / "p.csv").write_text("d,n_cases\na,2\nb,3\nc,x\n")
    assert [r["d"] for r in readers.read_profiles(spark, f"{tmp_path}/p.csv").collect()] == ["b"]
    with pytest.raises(ValueError):
        readers.read_profiles(spark, f"{tmp_path}/plain.json")
    assert [tuple(r) for r in readers.parse_names(spark, "a>b|c\n").collect()] == [("a", "b", "c")]


def test_release(spark):
    prov = "array<struct<chapter_path:string,source_sentence:string,passage_id:string,evidence_verbatim:boolean>>"
    nodes = spark.createDataFrame(
        [("a", "A", [("m / 1", "", "", True)]), ("b", "B", [("m / 1", "", "", True), ("k / 1", "", "", True)]), ("c", "C", [("m / 1", "", "", True)])], f"id string, name string, provenance {prov}"
    ).withColumns({"x": F.lit(1.0), "y": F.lit(1.0)})
    edges = spark.createDataFrame([("a", "b", "r", "m"), ("b", "c", "r", "k")], "subject_id string, object_id string, type string, corpus string")
    old = spark.createDataFrame([("b", "Old", 5.0, 6.0)], "id string, name string, x double, y double")
    out = R.withhold(Graph(nodes, edges), "m", old)
    assert {(r["id"], r["name"], r["x"], len(r["provenance"])) for r in out.nodes.collect()} == {("b", "Old", 5.0, 1), ("c", "C", 1.0, 0)}
    assert out.edges.count() == 1
    passages = spark.createDataFrame([("1", "m", DEMO := "2022年7月1日来诊", ["2022-07-01", "2022-07-03"], "95"), ("2", "k", DEMO, None, "30")], "pid string, source string, text string, visit_dates array<string>, age string")
    done = {r["pid"]: r for r in R.published_corpus(passages, "m").collect()}
    assert done["1"]["text"] == "2022年来诊" and done["1"]["visit_span_days"] == 2 and done["1"]["age"] == "90+" and done["2"]["text"] == DEMO
    assert R.published_corpus(passages, None).count() == 2


def test_cardinality_ends_in_one(spark):
    edges = spark.createDataFrame([("a", "x", "r"), ("a", "y", "r"), ("a", "x", "s"), ("a", "y", "s"), ("a", "x", "t"), ("a", "y", "t")], "subject_id string, object_id string, type string")
    ontology = spark.createDataFrame([("r", "1..1"), ("s", "0..1"), ("t", "0..*")], "type string, card string")
    assert {r["type"] for r in Q.cardinality_exceptions(edges, ontology).collect()} == {"r", "s"}


def test_exact_tails_against_all_tables(spark):
    cells = [(a, b, c, d) for a in range(5) for b in range(5) for c in range(5) for d in range(5) if a + b + c + d] + [(300, 700, 200, 5000), (0, 900, 40, 9000), (5, 900, 40, 100)]
    rows = spark.createDataFrame(cells, "a long, b long, c long, d long").select("a", "b", "c", "d", S.fisher_greater("a", "b", "c", "d").alias("p"))
    for r in rows.collect():
        row, col, n = r["a"] + r["b"], r["a"] + r["c"], sum(r[:4])
        want = sum(math.comb(row, x) * math.comb(n - row, col - x) for x in range(r["a"], min(row, col) + 1)) / math.comb(n, col)
        assert math.isclose(r["p"], want, rel_tol=1e-8, abs_tol=1e-12), r


def test_rank_correlation_p(spark):
    rows = spark.createDataFrame([(0.8, 5), (0.0, 10), (1.0, 4), (0.5, 30), (0.3, 2)], "rho double, n long").select(S.correlation_p("rho", "n").alias("p")).collect()
    assert [None if r["p"] is None else round(r["p"], 4) for r in rows] == [0.1041, 1.0, 0.0, 0.0049, None]


def test_cases_by_diagnosis_year_and_text(spark):
    records = spark.createDataFrame([("1", "Cough case", 2001, ["cold"]), ("2", "other", 2002, ["Cough"]), ("3", None, None, None)], "id string, title string, year int, diagnoses array<string>")
    ids = lambda **k: {r["id"] for r in P.case_list(records, **k).collect()}
    assert ids() == {"1", "2", "3"} and ids(q="cough") == {"1", "2"} and ids(year=2002) == {"2"} and ids(diagnosis="cold", q="x") == set()


def test_first_seen_engine_wins_ties(spark):
    edges = spark.createDataFrame([(1, "l", "b"), (2, "l", "a"), (3, "m", "a"), (4, "m", ""), (5, "m", "")], "ordinal int, layer string, engine string")
    from strandgraph.operators.release import engine_modes

    assert {tuple(r) for r in engine_modes(edges).collect()} == {("l", "b"), ("m", "a")}
