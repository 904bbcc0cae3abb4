"""Running values over whole tables: a fold of each range partition, carried on to the partitions after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

FOLDS = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, min), "max": (F.max, max)}


def running(rows: DataFrame, order: list[Column], value: Column | str, how: str, name: str) -> DataFrame:
    """rows with the sum, least or greatest value from the first row up to each, in a total order. Nulls add nothing.

    Rows are sorted by range; each partition is folded by itself, and the driver carries the folds on, one for each partition. No window
    is wider than one partition.
    """
    fold, join = FOLDS[how]
    ordered = cut(rows.withColumn("__v", value if isinstance(value, Column) else F.col(value)).orderBy(*order).withColumn("__p", F.spark_partition_id()))
    folds = ordered.groupBy("__p").agg(fold("__v").alias("f")).orderBy("__p").collect()
    carried, carry = None, []
    for p, f in folds:
        carry.append((p, carried))
        carried = f if carried is None else carried if f is None else join(carried, f)
    kind = ordered.groupBy().agg(fold("__v").alias("f")).schema["f"].dataType.simpleString()
    carries = rows.sparkSession.createDataFrame(carry, f"__p int, __c {kind}")
    own = fold("__v").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    whole = {"sum": F.coalesce(F.col("__own") + F.col("__c"), "__own", "__c"), "min": F.least("__own", "__c"), "max": F.greatest("__own", "__c")}[how]
    return ordered.withColumn("__own", own).join(F.broadcast(carries), "__p").withColumn(name, whole).drop("__p", "__v", "__own", "__c")
