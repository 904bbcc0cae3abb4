"""Exact order statistics of large groups: rounds of histograms, none of whose rows or buffers grow with a group.

Numbers become integers of the same order, which are found 16 bits at a time: count the values under each next 16
bits, go on in the one that holds the wanted rank. Four rounds at most, fewer once a count holds one value only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .graph import cut

BITS = 16


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Bits of a double to an integer of the same order, and back."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """An integer that orders as the number does: -0 is 0, and all that aren't numbers come last."""
    values = x.to_numpy(np.float64) + 0.0
    return pd.Series(_flipped(np.where(np.isnan(values), np.nan, values).view(np.int64)))


@F.pandas_udf(DoubleType())
def from_bits(x: pd.Series) -> pd.Series:
    return pd.Series(_flipped(x.to_numpy(np.int64)).view(np.float64))


def ranked_values(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """g, r, value: the r-th smallest x (from 1) of each group g of rows (g, x) asked for in ranks (g, r), both distinct there.

    Numbers are doubles. Ranks beyond a group give no row; nulls in x must be gone before.
    """
    return _selected(_keyed(rows), ranks)


def _keyed(rows: DataFrame) -> DataFrame:
    return cut(rows.select("g", ordered_bits(F.col("x").cast("double")).alias("k")))


def _selected(keyed: DataFrame, ranks: DataFrame) -> DataFrame:
    wanted = ranks.select("g", "r", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for shift in range(64 - BITS, -1, -BITS):
        if shift == 64 - BITS:
            inside = keyed.withColumn("prefix", F.lit(0).cast("long"))
        else:
            inside = keyed.withColumn("prefix", F.shiftright("k", shift + BITS)).join(wanted.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        counts = inside.groupBy("g", "prefix", F.shiftright("k", shift).alias("next")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        upward = Window.partitionBy("g", "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)  # 2^16 rows at most
        cumulated = counts.withColumn("to", F.sum("n").over(upward))
        at = F.col("r") - F.col("below")
        wanted = cut(
            wanted.select("g", "r", "prefix", "below").join(cumulated, ["g", "prefix"]).where((at <= F.col("to")) & (at > F.col("to") - F.col("n")))
            .select("g", "r", F.col("next").alias("prefix"), (F.col("below") + F.col("to") - F.col("n")).alias("below"), "lo", "hi")
        )
        if wanted.where("lo <> hi").isEmpty():
            break
    return wanted.select("g", "r", F.coalesce(from_bits("lo"), F.lit(float("nan"))).alias("value"))  # Arrow takes what isn't a number for a null


def quantiles(rows: DataFrame, group: list[str], value: str, points: dict[str, float], exclusive: bool = False) -> DataFrame:
    """group, n (values that aren't null) and a column for each point: linear between the values at place 1 + p (n - 1), or exclusive:
    at place p (n + 1) as textbooks' exclusive method has it, for groups of two or more. Without a group, one row of a table that isn't empty."""
    told = rows.where(F.col(value).isNotNull()).select((F.struct(*group) if group else F.struct(F.lit(0).alias("all"))).alias("g"), F.col(value).cast("double").alias("x"))
    keyed = _keyed(told)
    sizes = cut(keyed.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= (2 if exclusive else 1)))
    spots = []
    for name, p in points.items():
        if exclusive:
            low = F.least(F.greatest(F.floor(F.lit(p) * (F.col("n") + 1)), F.lit(1)), F.col("n") - 1)
            share = F.lit(p) * (F.col("n") + 1) - low
        else:
            low = F.least(F.floor(F.lit(p) * (F.col("n") - 1)) + 1, F.greatest(F.col("n") - 1, F.lit(1)))
            share = F.lit(p) * (F.col("n") - 1) + 1 - low
        spots.append(F.struct(F.lit(name).alias("name"), low.cast("long").alias("low"), share.cast("double").alias("share")))
    places = sizes.select("g", "n", F.explode(F.array(*spots)).alias("s")).select("g", "n", "s.*")
    ranks = places.select("g", F.explode(F.array("low", F.least(F.col("low") + 1, F.col("n")))).alias("r")).distinct()
    found = cut(_selected(keyed, ranks))
    of = lambda r, v: found.select("g", F.col("r").alias(r), F.col("value").alias(v))
    both = places.withColumn("high", F.least(F.col("low") + 1, F.col("n"))).join(of("low", "a"), ["g", "low"]).join(of("high", "b"), ["g", "high"])
    between = F.when((F.col("share") == 0) | (F.col("a") == F.col("b")), F.col("a")).when(F.col("share") == 1, F.col("b")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("share"))
    out = both.groupBy("g", "n").agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in points])
    return out.select(*[F.col("g")[c].alias(c) for c in group], "n", *points)
