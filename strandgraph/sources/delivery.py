"""Merging a delivery into a release: a keyed upsert over partitioned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..model import Graph
from ..operators.graph import cut, delete


def fingerprint(rows: DataFrame) -> Column:
    """A hash of a row's values, whatever the order of its maps."""
    plain = [F.array_sort(F.map_entries(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in rows.schema]
    return F.sha2(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}), 256)


def latest(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for each key, all of it given: the one of the greatest order, then of the greatest fingerprint."""
    whole = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    place = F.struct(*([F.col(order)] if order else []), fingerprint(whole.drop(order) if order else whole))
    columns = [c for c in rows.columns if c != order]
    best = whole.groupBy(*keys).agg(F.max_by(F.struct(*columns), place).alias("r"))
    return best.select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def merge_rows(spark: SparkSession, path: str, delivered: DataFrame, keys: list[str], partition: str, order: str | None = None) -> list[str]:
    """Upserts rows into Parquet files at path, in a folder for each value of `partition`; the values whose files were written.

    A delivered row replaces the one of its key, in whatever folder that lies, as a whole; others stay. Only folders that lose, gain or change
    a row are written: a delivery that brings nothing new writes nothing, so a repeated one leaves the same files.
    The rows to write are kept in the shared folder first, so that a job that fails while it writes is mended by running it again.
    Rows without a whole key or a partition value go; of several rows of one key the one of the greatest `order` counts, which isn't written.
    """
    new = cut(latest(delivered.where(F.col(partition).isNotNull()), keys, order))
    if not exists(spark, path):
        new.write.partitionBy(partition).parquet(path)
        return sorted(str(r[0]) for r in new.select(partition).distinct().collect())
    old = spark.read.schema(new.schema).parquet(path).select(new.columns)
    told = old.select(*keys, F.col(partition).alias("__was"), fingerprint(old).alias("__old"))
    changed = cut(
        new.withColumn("__new", fingerprint(new)).join(told, keys, "left").where(F.col("__old").isNull() | (F.col("__old") != F.col("__new"))).drop("__old", "__new")
    )
    touched = [r[0] for r in changed.select(F.explode(F.array(partition, "__was")).alias("p")).where("p is not null").distinct().collect()]  # as many as folders
    if not touched:
        return []
    stay = old.where(F.col(partition).isin(touched)).join(changed.select(keys), keys, "left_anti")
    rows = cut(stay.unionByName(changed.drop("__was")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    filled = {r[0] for r in rows.select(partition).distinct().collect()}
    for value in set(touched) - filled:  # folders that lost all their rows
        delete(spark, f"{path}/{partition}={value}")
    return sorted(map(str, touched))


def merge_delivery(spark: SparkSession, path: str, delivery: Graph, order: str | None = None) -> dict[str, list[str]]:
    """Merges a graph into the release at path: nodes by id in a folder for each class, then edges by (subject, object, type) in a folder for each
    layer. Edges need both ends among the nodes of the merged release. The folders written, by table."""
    nodes = merge_rows(spark, f"{path}/nodes", delivery.nodes, ["id"], "cls", order)
    ids = spark.read.parquet(f"{path}/nodes").select("id")
    edges = delivery.edges.join(ids.toDF("subject_id"), "subject_id", "left_semi").join(ids.toDF("object_id"), "object_id", "left_semi")
    return {"nodes": nodes, "edges": merge_rows(spark, f"{path}/edges", edges, ["subject_id", "object_id", "type"], "layer", order)}


def read_release(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
