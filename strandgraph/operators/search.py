"""Substring search over names, aliases and attributes by an inverted index of trigrams with places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, END = 3, "\x00"


def values(nodes: DataFrame) -> DataFrame:
    """id, field (a number within the node), value: lower-case name, aliases and attribute values that aren't null."""
    parts: list[Column] = [F.array("name")]
    if "aliases" in nodes.columns:
        parts.append(F.coalesce("aliases", F.array().cast("array<string>")))
    if "attrs" in nodes.columns:
        parts.append(F.coalesce(F.map_values("attrs"), F.array().cast("array<string>")))
    return nodes.select("id", F.posexplode(F.concat(*parts)).alias("field", "value")).where("value is not null").withColumn("value", F.lower("value"))


def postings(nodes: DataFrame) -> DataFrame:
    """gram, id, field, place: the GRAM characters from each place on, filled up with END at a value's end; an empty value has one."""
    own = values(nodes).withColumn("value", F.concat("value", F.lit(END * (GRAM - 1))))
    places = F.sequence(F.lit(0), F.greatest(F.length("value") - GRAM, F.lit(0)))
    grams = F.transform(places, lambda i: F.struct(F.substring("value", i + 1, F.lit(GRAM)).alias("gram"), i.alias("place")))
    return own.select("id", "field", F.explode(grams).alias("g")).select("g.gram", "id", "field", "g.place")


def write_index(nodes: DataFrame, path: str) -> None:
    """Postings as Parquet, sorted by gram, so that a search reads only the row groups of its grams."""
    postings(nodes).repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(path)


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """id of the nodes with a value that holds the text, letter case aside: what a scan with `contains` gives, from postings alone.

    Places verify: the text's grams must stand at neighbouring places of one value. A text shorter than a gram is looked for as
    a gram's beginning, and an empty one is held by every value.
    """
    rows, low = spark.read.parquet(path), text.lower()
    if len(low) < GRAM:
        return rows.where(F.col("gram").startswith(low) if low else F.col("place") == 0).select("id").distinct()
    grams: dict[str, list[int]] = {}
    for i in range(len(low) - GRAM + 1):
        grams.setdefault(low[i : i + GRAM], []).append(i)
    steps = F.create_map(*[x for g, at in grams.items() for x in (F.lit(g), F.array(*map(F.lit, at)))])
    hits = rows.where(F.col("gram").isin(*grams)).select("id", "field", F.explode(F.transform(steps[F.col("gram")], lambda i: F.col("place") - i)).alias("begin"))
    return hits.groupBy("id", "field", "begin").agg(F.count("*").alias("n")).where(F.col("n") == len(low) - GRAM + 1).select("id").distinct()
