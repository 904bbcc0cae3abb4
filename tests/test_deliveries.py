"""Merged releases, Turtle, the search index and strings of JSON, against plain Python."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from strandgraph.functions.privacy import ID_FIELDS, PrivacyError, json_leaves
from strandgraph.model import Graph
from strandgraph.operators import pattern as P
from strandgraph.operators import search
from strandgraph.sources import delivery, turtle, writers

NODES = "id string, cls string, name string, attrs map<string,string>"
EDGES = "subject_id string, object_id string, type string, layer string, n_support int"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def held(spark, path):
    return sorted((r["id"], r["cls"], r["name"], r["attrs"]) for r in spark.read.parquet(path).collect())


def test_merge_writes_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "release")
    first = [(f"n{i}", "abc"[i % 3], f"name{i}", {"k": str(i), "j": "x"}) for i in range(12)]
    graph = lambda nodes, edges: Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    edges = [(f"n{i}", f"n{i + 1}", "t", "l1" if i % 2 else "l2", 1) for i in range(11)] + [("n0", "gone", "t", "l1", 1)]
    delivery.merge_delivery(spark, path, graph(first, edges))
    assert held(spark, f"{path}/nodes") == sorted(first) and spark.read.parquet(f"{path}/edges").count() == 11
    before = files(path)
    assert delivery.merge_delivery(spark, path, graph([(i, c, n, dict(reversed(a.items()))) for i, c, n, a in first], edges)) == {"nodes": [], "edges": []}
    assert files(path) == before
    moved = [("n0", "b", "moved", {}), ("n1", "b", "name1", {"k": "1", "j": "x"}), ("new", "d", "n", None), (None, "a", "no key", None), ("lost", None, "no class", None)]
    told = delivery.merge_delivery(spark, path, graph(moved, [("n0", "new", "t", "l3", 7), ("n0", "n1", "t", "l3", 2)]))
    assert told == {"nodes": ["a", "b", "d"], "edges": ["l2", "l3"]}
    want = {r[0]: r for r in first} | {r[0]: r for r in moved[:3]}
    assert held(spark, f"{path}/nodes") == sorted(want.values(), key=lambda r: r[0])
    after = files(path)
    assert {f for f in before if "cls=c" in f or "layer=l1" in f} == {f for f in after if "cls=c" in f or "layer=l1" in f} and all(after[f] == t for f, t in before.items() if "cls=c" in f or "layer=l1" in f)
    keys = [(r["subject_id"], r["object_id"], r["type"]) for r in spark.read.parquet(f"{path}/edges").collect()]
    assert len(keys) == len(set(keys)) == 12
    assert delivery.read_release(spark, path).nodes.count() == 13


def test_merge_empties_a_folder_and_takes_the_latest(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, cls string, v int, seq int")
    delivery.merge_rows(spark, path, rows(("a", "x", 1, 1), ("a", "y", 2, 0), ("b", "z", 3, 0)), ["id"], "cls", "seq")
    assert sorted((r["id"], r["cls"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", "x", 1), ("b", "z", 3)]
    assert delivery.merge_rows(spark, path, rows(("a", "z", 5, 1)), ["id"], "cls", "seq") == ["x", "z"]
    assert sorted((r["id"], r["cls"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", "z", 5), ("b", "z", 3)]
    assert not os.path.exists(f"{path}/cls=x")


def test_what_is_written_as_turtle_reads_back(spark, tmp_path):
    nodes = [("a:1", "Herb", 'quo"te \\ back\tslash', {"k": "é 😀", "m": "line\nbreak"}), ("b:2", "Case", "", None)]
    edges = [("a:1", "b:2", "uses", "l", 1), ("a:1", "b:2", "uses", "l", 2)]
    graph = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    n = writers.write_turtle(graph, str(tmp_path / "ttl"), ("n_support",))
    got = {tuple(r) for r in turtle.read_triples(spark, str(tmp_path / "ttl")).collect()}
    assert len(got) == n
    plain = {r for r in got if not r[0].startswith("_:")}
    assert plain == {
        ("a:1", "a", "Herb", "iri", None), ("a:1", "name", 'quo"te \\ back\tslash', "literal", "zh"), ("a:1", "k", "é 😀", "literal", "zh"), ("a:1", "m", "line break", "literal", "zh"),
        ("b:2", "a", "Case", "iri", None), ("b:2", "name", "", "literal", "zh"), ("a:1", "uses", "b:2", "iri", None),
    }
    assert {r[1:] for r in got - plain} == {("subject", "a:1", "iri", None), ("object", "b:2", "iri", None), ("predicate", "uses", "literal", None), ("n_support", "1", "literal", None), ("n_support", "2", "literal", None)}


TURTLE = r'''@prefix : <http://x/> . PREFIX ex: <http://e/>
@base <http://b/> . # a comment . with <marks>
:s a ex:C ; ex:p "one"@en-GB, 'two', """three "quoted"
lines""" ; ; ex:q 1, -2.5, 3e4, true .
<rel> ex:r [ ex:in ( :a "b" ) ; ex:of _:n1 ] . [] ex:t "7"^^ex:int . _:n1 ex:u <http://full/é> . ex:a.b ex:esc "\té\U0001F600\"" .
[ ex:only :x ] .'''


def test_turtle_syntax(spark, tmp_path):
    rdf, xsd = turtle.RDF, turtle.XSD
    rows = list(turtle.Document(TURTLE).statements())
    e, x = "http://e/", "http://x/"
    assert rows[:5] == [
        (x + "s", rdf + "type", e + "C", "iri", None, None), (x + "s", e + "p", "one", "literal", "en-GB", None), (x + "s", e + "p", "two", "literal", None, None),
        (x + "s", e + "p", 'three "quoted"\nlines', "literal", None, None), (x + "s", e + "q", "1", "literal", None, xsd + "integer"),
    ]
    assert [r[2::3] for r in rows[5:8]] == [("-2.5", xsd + "decimal"), ("3e4", xsd + "double"), ("true", xsd + "boolean")]
    by = {r[1]: r for r in rows[8:]}
    inner = by[e + "r"][2]
    assert by[e + "r"][0] == "http://b/rel" and by[e + "of"] == (inner, e + "of", "_:n1", "blank", None, None) and by[e + "in"][0] == inner
    assert {r[2] for r in rows if r[1] == rdf + "first"} == {x + "a", "b"} and sum(r[2] == rdf + "nil" for r in rows) == 1
    assert by[e + "t"][2:] == ("7", "literal", None, e + "int") and by[e + "u"][2] == "http://full/é"
    assert by[e + "esc"][0] == e + "a.b" and by[e + "esc"][2] == '\té😀"' and by[e + "only"][2] == x + "x"
    for wrong in (":s :p :o .", "<a> <b> .", "<a> <b> <c>", '<a> <b> "open .', "<a> <b> <c> . ]"):
        with pytest.raises((ValueError, KeyError)):
            list(turtle.Document(wrong).statements())
    for i in range(3):
        (tmp_path / f"{i}.ttl").write_text(TURTLE)
    (tmp_path / "empty.ttl").write_text("")
    got = turtle.read_turtle(spark, str(tmp_path))
    assert got.count() == 3 * len(rows) and got.where("kind = 'blank'").select("o").distinct().count() == 3 * len({r[2] for r in rows if r[3] == "blank"})


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("aAbé# ") for _ in range(n))
    rows = [(f"i{k}", "c", word(rng.randrange(0, 12)), [word(5)] if k % 3 else None, {"p": word(7), "q": None} if k % 2 else None) for k in range(80)] + [("none", "c", None, None, None), ("rep", "c", "aaaaaa", [], {})]
    nodes = spark.createDataFrame(rows, "id string, cls string, name string, aliases array<string>, attrs map<string,string>")
    path = str(tmp_path / "index")
    search.write_index(nodes, path)
    for text in ("", "A", "ab", "aba", "AAAA", "é#", "b é", "aaaaaa", "aaaaaaa", "zz", "# a"):
        want = {r["id"] for r in P.search_nodes(nodes, text).collect()}
        assert {r["id"] for r in search.search(spark, path, text).collect()} == want, text
    plan = search.search(spark, path, "abab")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "In(gram" in plan and "Join" not in plan


def leaves(value, path="$"):
    if isinstance(value, str):
        if value:
            yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            if k not in ID_FIELDS:
                yield from leaves(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")


def test_strings_of_json_against_recursion(spark):
    def made(rng, depth):
        kind = rng.randrange(6) if depth else rng.randrange(3)
        if kind < 3:
            return rng.choice(["", "text", "é\"\\", 5, 1.5, None, True])
        if kind == 3:
            return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcde") + str(i): made(rng, depth - 1) for i in range(rng.randrange(4))} | ({"id": "hidden"} if rng.random() < 0.3 else {})

    rng = random.Random(7)
    values = [made(rng, 5) for _ in range(120)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(500, None), (501, "{broken"), (502, ""), (503, '"alone"')]
    want = sorted((i, p, t) for i, v in [*enumerate(values), (503, "alone")] for p, t in leaves(v))
    assert sorted(tuple(r) for r in json_leaves(spark.createDataFrame(rows, "k int, j string"), "k", "j").collect()) == want
    assert json_leaves(spark.createDataFrame([], "k int, j string"), "k", "j").collect() == []


def test_private_export_reads_json_and_resolves_paths(spark, tmp_path):
    public, own = tmp_path / "public", tmp_path / "own"
    public.mkdir()
    (tmp_path / "link").symlink_to(public)
    names = spark.createDataFrame([("张三丰",)], "name string")
    good = spark.createDataFrame([("1", '{"a": ["fine"]}')], "id string, j string")
    bad = spark.createDataFrame([("1", '{"a": [{"b": "2022年7月1日来诊"}]}')], "id string, j string")
    for inside in (f"{public}/x", f"{tmp_path}/link/x", f"file://{public}/x", f"{tmp_path}/own/../public", str(public)):
        with pytest.raises(ValueError):
            writers.private_export(good, names, inside, str(public), json_col="j")
    with pytest.raises(PrivacyError):
        writers.private_export(bad, names, str(own), str(public), json_col="j")
    writers.private_export(good, names, f"{public}-2/x", str(public), json_col="j")
    assert spark.read.json(f"{public}-2/x").count() == 1


def test_filters_on_attributes_reach_the_files(spark):
    from strandgraph.model import attr
    from strandgraph.sources.testdata import star_graph

    nodes = star_graph(spark, "/root/testdata/sf0.001").of("part").where(attr("p_size") == "7").select("id")
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(p_size)" in plan and "p_retailprice" not in plan
    assert nodes.where(F.col("id").isNull()).count() == 0
