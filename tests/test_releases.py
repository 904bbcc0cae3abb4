"""Readers, writers and derivations that files or other scripts need, against plain expectations."""

import json

import pytest
from pyspark.sql import functions as F
from strandgraph.functions import text as X
from strandgraph.model import Graph, first_filled
from strandgraph.operators import release as R
from strandgraph.operators import stats as S
from strandgraph.sources import readers, turtle, writers


def test_a_graph_of_the_stated_size(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "cls": "A", "name": "x", "aliases": ["y"], "attrs": {"k": "v"}}, {"id": "b", "cls": "B", "name": "z"}], "edges": [{"subject_id": "a", "object_id": "b", "type": "t", "n_support": 3}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    graph = readers.require_size(readers.read_graph_json(spark, f"{tmp_path}/g.json"), 2, 1)
    assert [(r["id"], r["attrs"], r["aliases"]) for r in graph.nodes.orderBy("id").collect()] == [("a", {"k": "v"}, ["y"]), ("b", None, None)]
    assert graph.edges.first()["n_support"] == 3
    with pytest.raises(ValueError):
        readers.require_size(graph, 2, 2)


ONTOLOGY = {
    "classes": {"Herb": {"zh": "药", "attrs": ["dose", "place"], "modalities": ["m"]}, "Case": {"zh": '案"', "attrs": ["place"]}},
    "object_properties": {"uses": {"zh": "用", "domain": "Case", "range": "Herb", "card": "0..1", "qualifier": ["dose", "unit"]}, "has": {"zh": "有", "domain": "Case", "range": "Case", "card": "1..1"}, "many": {"zh": "多", "domain": "Case", "range": "Herb", "card": "0..*"}},
}


def test_ontology_reads_and_writes_back_as_turtle(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps(ONTOLOGY))
    classes, relations = readers.read_ontology(spark, f"{tmp_path}/o.json")
    assert {r["cls"]: r["attrs"] for r in classes.collect()} == {"Herb": ["dose", "place"], "Case": ["place"]}
    assert {r["type"]: (r["domain"], r["range"], r["card"], r["qualifier"]) for r in relations.collect()}["uses"] == ("Case", "Herb", "0..1", ["dose", "unit"])
    exceptions = spark.createDataFrame([("uses", 5, 3)], "type string, by_rows long, by_objects long")
    used = classes.withColumn("undeclared_attrs", F.when(F.col("cls") == "Herb", F.array(F.lit("colour"))))
    notes = spark.createDataFrame([("engine", "引擎", "what extracted it")], "name string, zh string, comment string")
    writers.write_ontology([writers.ontology_lines(classes, relations, exceptions), writers.attribute_lines(used), writers.annotation_lines(notes)], f"{tmp_path}/ttl")
    rows = turtle.read_triples(spark, f"{tmp_path}/ttl/*.txt").collect()
    owl, rdfs = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"
    of = lambda s, p: {r["o"] for r in rows if r["s"] == s and r["p"] == p}
    assert of("Herb", "a") == {owl + "Class"} and of("Case", rdfs + "label") == {"Case", '案"'}
    assert of("has", "a") == {owl + "ObjectProperty", owl + "FunctionalProperty"} and of("uses", "a") == of("many", "a") == {owl + "ObjectProperty"}
    assert of("uses", rdfs + "comment") == {"declared 0..1, but 3 subjects have several objects"} and of("has", rdfs + "comment") == set()
    assert of("uses", "qualifier") == {"dose / unit"} and of("uses", "cardinality") == {"0..1"} and of("uses", rdfs + "domain") == {"Case"} and of("uses", rdfs + "range") == {"Herb"}
    assert of("dose", rdfs + "domain") == {"Herb"} and of("colour", rdfs + "comment") and not of("dose", rdfs + "comment")
    (union,) = of("place", rdfs + "domain")
    (head,) = of(union, owl + "unionOf")
    first, rest = turtle.RDF + "first", turtle.RDF + "rest"
    (tail,) = of(head, rest)
    assert of(union, "a") == {owl + "Class"} and of(head, first) == {"Case"} and of(tail, first) == {"Herb"} and of(tail, rest) == {turtle.RDF + "nil"}
    assert of("engine", "a") == {owl + "AnnotationProperty"}


def test_compact_nodes(spark):
    record = [(f"c{i}", f"s{i}", "p", i % 2 == 0) for i in range(10)]
    rows = [("a", "N", "C", 3, 1.234, None, 0, ["x"], {"k": "v", "e": "", "n": None}, 10, record), ("b", "M", "C", None, None, None, None, [], {}, 0, [])]
    schema = "id string, name string, cls string, n_mentions int, x double, y double, component int, aliases array<string>, attrs map<string,string>, n_provenance int, provenance array<struct<chapter_path:string,source_sentence:string,passage_id:string,evidence_verbatim:boolean>>"
    a, b = (json.loads(r["value"]) for r in writers.compact(spark.createDataFrame(rows, schema)).collect())
    assert b == {"i": "b", "n": "M", "c": "C", "pvn": 0}
    assert {k: a[k] for k in "incmxk"} == {"i": "a", "n": "N", "c": "C", "m": 3, "x": 1.23, "k": 0} and a["a"] == ["x"] and a["at"] == {"k": "v"} and "y" not in a
    assert len(a["pv"]) == 8 and a["pv"][0] == {"s": "s0", "c": "c0", "p": "p"} and a["pv"][1]["v"] is False


def test_qc_document(spark, tmp_path):
    audit = spark.createDataFrame([("nodes", "B", 2), ("nodes", 'A"', 1), ("integrity", None, 0)], "metric string, key string, value long")
    writers.write_qc(audit, f"{tmp_path}/qc")
    text = spark.read.text(f"{tmp_path}/qc").first()[0]
    assert json.loads(text) == {"integrity": {"": 0}, "nodes": {'A"': 1, "B": 2}} and text.index("integrity") < text.index("nodes")
    assert writers.qc_document(audit.limit(0)).count() <= 1


def test_one_source_of_a_corpus(spark, tmp_path):
    passages = spark.createDataFrame([("1", "s", "ab", 2), ("2", "s", "c", 1), ("3", "t", "d", 1)], "pid string, source string, text string, n_chars int")
    writers.write_corpus(passages, f"{tmp_path}/c")
    one = readers.read_source(spark, f"{tmp_path}/c", "s")
    assert {tuple(r) for r in one.collect()} == {("1", "s", "ab", 2), ("2", "s", "c", 1)}
    assert "PartitionFilters: [isnotnull(source" in one._jdf.queryExecution().executedPlan().toString()
    assert [r["pid"] for r in readers.read_source(spark, f"{tmp_path}/c", "s", passages.where("pid <> '1'")).collect()] == ["2"]


def test_chains_of_fields(spark):
    rows = spark.createDataFrame([("", None, "c"), (None, "b", "c"), ("a", "b", "c"), (None, "", None)], "x string, y string, z string")
    assert [r[0] for r in rows.select(first_filled(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["c", "b", "a", ""]


def test_tags_of_sputum(spark):
    texts = ["痰多色白", "痰中带血", "无", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.tagged(F.col("t"), X.SPUTUM_RULES)).collect()]
    import re

    assert got[:3] == [[n for n, p in X.SPUTUM_RULES if re.search(p, t)] for t in texts[:3]]


def test_one_corpus_is_redacted(spark):
    edges = spark.createDataFrame([("a", "m", "2022年7月1日来诊"), ("b", "k", "2022年7月1日来诊"), ("c", None, "x"), ("d", "m", None)], "subject_id string, corpus string, source_sentence string")
    got = {r["subject_id"]: (r["source_sentence"], r["hits"]) for r in R.redacted_edges(edges, "m").collect()}
    assert got["a"][0] == "2022年来诊" and sum(got["a"][1].values()) == 1
    assert got["b"] == ("2022年7月1日来诊", None) and got["c"] == ("x", None) and got["d"][0] is None


def test_origins_fill_only_gaps(spark):
    rows = [("r", "卷一 / x", "", ""), ("r", "卷二 / x", "own", ""), ("q", "第三章 / y", None, None), ("r", "unknown", "", "kept")]
    edges = spark.createDataFrame(rows, "type string, chapter_path string, corpus string, layer string")
    got = [(r["corpus"], r["layer"]) for r in R.with_origin(edges, {"卷一": "one"}, {"r": "rel"}, "numbered", "numbered").collect()]
    assert got == [("one", "rel"), ("own", "rel"), ("numbered", "modern_case"), ("", "kept")]


def test_grids_with_too_many_classes(spark):
    members = spark.createDataFrame([(i, f"i{i % 3}", f"c{i}") for i in range(6)], "u int, i string, c string")
    with pytest.raises(ValueError):
        S.contingency(members, "i", "c", "u", most_classes=5)
    cells = {(r["i"], r["c"]): (r["a"], r["b"], r["c"] and r["d"]) for r in S.contingency(members, "i", "c", "u").collect()}
    some = S.contingency(members, "i", "c", "u", empty=False, most_classes=1)
    assert len(cells) == 18 and some.count() == 6


def test_undeclared_attributes(spark):
    nodes = spark.createDataFrame([("a", "A", {"x": "1", "y": "2"}), ("b", "B", {"x": "1"}), ("c", "C", None)], "id string, cls string, attrs map<string,string>")
    classes = spark.createDataFrame([("A", ["x"]), ("B", None)], "cls string, attrs array<string>")
    assert {tuple(r) for r in R.undeclared_attributes(nodes, classes).collect()} == {("A", "y"), ("B", "x")}


def test_layers_and_partitioned_graph(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A")], "id string, cls string")
    edges = spark.createDataFrame([("a", "a", "t", "l1"), ("a", "a", "u", "l2")], "subject_id string, object_id string, type string, layer string")
    writers.write_partitioned(Graph(nodes, edges), f"{tmp_path}/g")
    back = spark.read.parquet(f"{tmp_path}/g/edges").where("layer = 'l1'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(layer" in back._jdf.queryExecution().executedPlan().toString()
