"""Writers of graphs: JSON Lines, typed CSV, compact payload, triples, ontology, and publishing behind the gate."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.privacy import json_leaves, privacy_gate, require_clean, string_leaves
from ..model import Graph, first_filled
from ..operators.triples import literal, statements, triples, turtle_lines

EDGE_COLUMNS = "corpus source_sentence chapter_path passage_id engine agreement dose dose_note role condition".split()


def observed_attributes(nodes: DataFrame, ontology: DataFrame | None = None) -> list[str]:
    """Attribute names in use: those of the ontology (cls, attrs) in its order, then others by name. Names are metadata."""
    used = {r[0] for r in nodes.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().collect()}
    declared = [] if ontology is None else [a for r in ontology.select("attrs").collect() for a in r[0] or []]
    first = list(dict.fromkeys(a for a in declared if a in used))
    return first + sorted(used - set(first))


def from_first(name: str) -> Column:
    """The edge's own field, else its first provenance record's, else empty."""
    return first_filled(F.col(name), F.get("provenance", 0)[name])


def flag(c: Column) -> Column:
    return F.when(c, "true").when(~c, "false").otherwise("")


def node_table(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """Nodes under typed headers, aliases joined by ;."""
    col = lambda n: F.col(n) if n in nodes.columns else F.lit(None).cast("string")
    aliases = F.array_join(F.coalesce(col("aliases").cast("array<string>"), F.array().cast("array<string>")), ";")
    return nodes.select(
        F.col("id").alias(":ID"), F.col("name").alias("name:string"), aliases.alias("aliases:string[]"), F.col("cls").alias(":LABEL"),
        col("n_mentions").alias("n_mentions:int"), col("n_provenance").alias("n_provenance:int"), col("x").alias("x:float"), col("y").alias("y:float"), col("component").alias("component:int"),
        *[F.coalesce(F.try_element_at("attrs", F.lit(a)), F.lit("")).alias(f"{a}:string") for a in attributes],
    )


def edge_table(edges: DataFrame) -> DataFrame:
    """Edges under typed headers; missing flags are empty; empty fields fall back on the first provenance record."""
    has = set(edges.columns)
    told = "provenance" in has
    text = lambda n: from_first(n) if told and n in has and n in ("source_sentence", "chapter_path", "passage_id", "engine", "agreement") else F.coalesce(F.col(n), F.lit("")) if n in has else F.lit("")
    bool_ = lambda n: flag(F.col(n)) if n in has else F.lit("")
    return edges.select(
        F.col("subject_id").alias(":START_ID"), F.col("object_id").alias(":END_ID"), F.col("type").alias(":TYPE"), F.col("n_support").alias("n_support:int"),
        F.col("layer").alias("layer:string"), *[text(n).alias(f"{n}:string") for n in EDGE_COLUMNS[:4]],
        bool_("evidence_verbatim").alias("evidence_verbatim:boolean"), bool_("evidence_in_passage").alias("evidence_in_passage:boolean"), *[text(n).alias(n if n in ("dose", "dose_note", "role", "condition") else f"{n}:string") for n in EDGE_COLUMNS[4:]],
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_table(rows: DataFrame, path: str, order: list[str]) -> None:
    """A report of some hundreds of rows as one CSV file that begins with a byte-order mark, for spreadsheets."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    field = lambda c: F.when(c.rlike('[",\n\r]'), quoted(c)).otherwise(F.coalesce(c, F.lit("")))
    head = "\ufeff" + ",".join('"' + n.replace('"', '""') + '"' if re.search('[",\n\r]', n) else n for n in rows.columns)
    line = F.concat_ws(",", *[field(F.col(f"`{n}`").cast("string")) for n in rows.columns])
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("r"), line.alias("value"))
    first = rows.sparkSession.createDataFrame([(0, head)], "r int, value string")
    first.union(numbered).coalesce(1).sortWithinPartitions("r").select("value").write.mode("overwrite").text(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system's scheme and authority, links of local folders followed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file:" + os.path.realpath(re.sub("^file:/*", "/", whole)) if whole.startswith("file:") else whole


def private_export(records: DataFrame, names: DataFrame, path: str, public: str, id_col: str = "id", json_col: str | None = None) -> None:
    """Writes records that must not be published as JSON: never into the public folder, and only if no string of theirs,
    at any depth, holds personal data. json_col: a column of JSON texts, whose strings count, too."""
    spark = records.sparkSession
    inside, outside = qualified(spark, path), qualified(spark, public)
    if f"{inside}/".startswith(f"{outside.rstrip('/')}/"):
        raise ValueError(f"{path} lies in the public folder {public}")
    texts = records.select(F.col(id_col), F.explode(string_leaves(records.drop(json_col) if json_col else records)).alias("text"))
    if json_col:
        texts = texts.union(json_leaves(records, id_col, json_col).select(id_col, "text"))
    require_clean(privacy_gate(texts.withColumn("strict", F.lit(True)), names, id_col, "text", "strict"))
    records.write.mode("overwrite").json(path)


def write_graph_csv(graph: Graph, path: str, attributes: list[str]) -> None:
    write_csv(node_table(graph.nodes, attributes), f"{path}/nodes")
    write_csv(edge_table(graph.edges), f"{path}/edges")


def write_graph_lines(graph: Graph, path: str) -> None:
    """One JSON object for each node and edge; text isn't escaped to ASCII."""
    graph.nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.write.mode("overwrite").json(f"{path}/edges")


def write_partitioned(graph: Graph, path: str) -> None:
    """Parquet, edges in a folder for each layer: filters on the layer read only its files."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/edges")


def compact(nodes: DataFrame, provenance: int = 8) -> DataFrame:
    """value: a node as JSON under short keys, nulls and empties left out, at most 8 provenance records."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    records = F.transform(F.slice("provenance", 1, provenance), lambda p: F.struct(p["source_sentence"].alias("s"), p["chapter_path"].alias("c"), p["passage_id"].alias("p"), F.when(~p["evidence_verbatim"], False).alias("v")))
    attrs = F.map_filter("attrs", lambda k, v: v.isNotNull() & (v != ""))
    row = F.struct(
        F.col("id").alias("i"), F.col("name").alias("n"), F.col("cls").alias("c"), F.col("n_mentions").alias("m"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"),
        F.col("component").alias("k"), some("aliases").alias("a"), F.when(F.size(attrs) > 0, attrs).alias("at"), F.col("n_provenance").alias("pvn"), F.when(F.size("provenance") > 0, records).alias("pv"),
    )
    return nodes.select(F.to_json(row, {"ignoreNullFields": "true"}).alias("value"))


def write_turtle(graph: Graph, path: str, qualifiers: tuple[str, ...] = (), lang: str = "zh") -> int:
    """Triples of nodes, edges and reified statements as Turtle; the number of lines."""
    facts = turtle_lines(triples(graph, lang))
    told = statements(graph.edges, qualifiers)
    kinds = told.withColumn("kind", F.when(F.col("p").isin("subject", "object"), "iri").otherwise("literal")).withColumn("lang", F.lit(None).cast("string"))
    lines = facts.union(turtle_lines(kinds)).distinct()
    lines.write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path).count()


def ontology_lines(classes: DataFrame, relations: DataFrame, exceptions: DataFrame) -> DataFrame:
    """value: Turtle of classes and relations. Relations whose cardinality ends in ..1 are functional unless subjects break that
    (exceptions: type, by_objects), whose number a comment states then; cardinality and qualifiers (if relations have any) are annotations."""
    iri = lambda c: F.concat(F.lit(":"), c)
    text = lambda c, lang="": F.concat(F.lit('"'), literal(c), F.lit('"' + lang))
    label = lambda row, name: F.concat(F.lit(" ; rdfs:label "), text(F.col(name), "@en"), F.coalesce(F.concat(F.lit(", "), text(F.col("zh"), "@zh")), F.lit(""))) if "zh" in row.columns else F.concat(F.lit(" ; rdfs:label "), text(F.col(name), "@en"))
    of_class = classes.select(F.concat(iri(F.col("cls")), F.lit(" a owl:Class"), label(classes, "cls"), F.lit(" .")).alias("value"))
    number = F.col("by_objects") if "by_objects" in exceptions.columns else F.lit(None).cast("long")
    broken = exceptions.groupBy("type").agg(F.lit(True).alias("broken"), F.sum(number).alias("subjects"))
    single = F.col("card").endswith("..1")
    kind = F.when(single & F.col("broken").isNull(), "owl:ObjectProperty, owl:FunctionalProperty").otherwise("owl:ObjectProperty")
    said = F.concat(F.lit("declared "), F.col("card"), F.lit(", but "), F.coalesce(F.col("subjects").cast("string"), F.lit("some")), F.lit(" subjects have several objects"))
    comment = F.when(single & F.col("broken").isNotNull(), F.concat(F.lit(" ; rdfs:comment "), text(said, "@en"))).otherwise("")
    qualifier = F.when(F.size("qualifier") > 0, F.concat(F.lit(" ; :qualifier "), text(F.array_join("qualifier", " / ")))).otherwise("") if "qualifier" in relations.columns else F.lit("")
    of_type = relations.join(F.broadcast(broken), "type", "left").select(
        F.concat(
            iri(F.col("type")), F.lit(" a "), kind, label(relations, "type"), F.lit(" ; rdfs:domain "), iri(F.col("domain")), F.lit(" ; rdfs:range "), iri(F.col("range")),
            F.lit(" ; :cardinality "), text(F.col("card")), comment, qualifier, F.lit(" ."),
        ).alias("value")
    )
    return of_class.union(of_type)


def attribute_lines(classes: DataFrame) -> DataFrame:
    """value: Turtle of attributes, of classes (cls, attrs, undeclared_attrs): their domain is the class, or the union of the classes in order, that has them; one
    that no class declares says so."""
    none = F.array().cast("array<string>")
    told = lambda c, d: F.transform(F.coalesce(c, none), lambda a: F.struct(a.alias("attr"), F.lit(d).alias("declared")))
    both = F.concat(told("attrs", True), told("undeclared_attrs", False))
    each = classes.select("cls", F.explode(both).alias("a")).select("cls", "a.*")
    named = each.groupBy("attr").agg(F.sort_array(F.collect_set(F.concat(F.lit(":"), "cls"))).alias("of"), F.bool_or("declared").alias("declared"))
    domain = F.when(F.size("of") == 1, F.col("of")[0]).otherwise(F.concat(F.lit("[ a owl:Class ; owl:unionOf ( "), F.array_join("of", " "), F.lit(" ) ]")))
    comment = F.when(F.col("declared"), "").otherwise(' ; rdfs:comment "in use, but not declared"@en')
    return named.select(F.concat(F.lit(":"), "attr", F.lit(' a owl:DatatypeProperty ; rdfs:label "'), literal(F.col("attr")), F.lit('"@en ; rdfs:domain '), domain, comment, F.lit(" ; rdfs:range xsd:string .")).alias("value"))


def annotation_lines(annotations: DataFrame) -> DataFrame:
    """value: Turtle of annotation properties (name, zh, comment)."""
    text = lambda c, lang: F.concat(F.lit('"'), literal(F.col(c)), F.lit(f'"@{lang}'))
    return annotations.select(F.concat(F.lit(":"), "name", F.lit(" a owl:AnnotationProperty ; rdfs:label "), text("name", "en"), F.lit(", "), text("zh", "zh"), F.lit(" ; rdfs:comment "), text("comment", "en"), F.lit(" .")).alias("value"))


#: What an ontology file begins with.
PREFIXES = "@prefix : <{base}> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> ."


def write_ontology(lines: list[DataFrame], path: str, base: str = "urn:strandgraph:") -> None:
    """One Turtle file of ontology lines, prefixes first."""
    spark = lines[0].sparkSession
    out = spark.createDataFrame([(0, PREFIXES.format(base=base))], "part int, value string")
    for i, rows in enumerate(lines):
        out = out.union(rows.select(F.lit(i + 1), "value"))
    out.coalesce(1).sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def qc_document(audit: DataFrame) -> DataFrame:
    """value: one JSON document {metric: {key: value}} of audit rows (metric, key, value), metrics and keys in order."""
    of = audit.groupBy("metric").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("key", F.lit("")), "value")))).alias("m"))
    return of.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.to_json("m").alias("j"))))).alias("d")).select(
        F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("d"), lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"^\[(.*)\]$", 1), F.lit(":"), e["value"])), ","), F.lit("}")).alias("value")
    )


def write_qc(audit: DataFrame, path: str) -> None:
    qc_document(audit).coalesce(1).write.mode("overwrite").text(path)


def write_corpus(passages: DataFrame, path: str) -> None:
    """Parquet in a folder for each source: readers.read_source reads the one's files only."""
    passages.write.mode("overwrite").partitionBy("source").parquet(path)


def publish(gate: DataFrame, writes: list[Callable[[], None]]) -> None:
    """Runs the writes only if the gate holds no problem."""
    require_clean(gate)
    for write in writes:
        write()
