"""Frequent itemsets, rules and item networks over baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Rounds
from .pattern import pairs_within


def itemsets(members: DataFrame, basket: str, item: str, min_support: float, longest: int = 3) -> DataFrame:
    """items (ordered array), n of itemsets that at least min_support of all baskets hold.

    Level by level: each basket's frequent items are extended by its larger frequent items, and an
    extension counts only if all its subsets one smaller are frequent. Each level is written before the next reads it;
    of what baskets hold, only the frequent itemsets that are to grow on are written.
    """
    rounds = Rounds(members.sparkSession)
    rows = rounds.put("rows", members.select(basket, item).distinct())
    least = min_support * rows.select(basket).distinct().count()
    keep = lambda counts: counts.where(F.col("n") >= least)
    level = rounds.put("level1", keep(rows.groupBy(F.array(item).alias("items")).agg(F.count("*").alias("n"))))
    out = level
    own = rounds.put("own", rows.join(level.select(F.col("items")[0].alias(item)), item, "left_semi"))
    held = own.select(basket, F.array(item).alias("items"))
    for size in range(2, longest + 1):
        grown = held.join(own, basket).where(F.element_at("items", -1) < F.col(item)).select(basket, F.array_append("items", F.col(item)).alias("items"))
        counts = keep(grown.groupBy("items").agg(F.count("*").alias("n")))
        if size > 2:
            subsets = counts.select("items", F.explode(F.transform(F.col("items"), lambda x: F.array_remove("items", x))).alias("sub"))
            known = subsets.join(level.select(F.col("items").alias("sub")), "sub").groupBy("items").agg(F.count("*").alias("k")).where(F.col("k") == size)
            counts = counts.join(known.select("items"), "items", "left_semi")
        level = rounds.put(f"level{size}", counts)
        if size < longest:
            held = rounds.put("held", grown.join(level.select("items"), "items", "left_semi").select(basket, "items"))
        out = out.union(level)
    return rounds.result(out)


def rules(sets: DataFrame, n_baskets: int, min_confidence: float, min_lift: float = 1.0, consequents: int = 2) -> DataFrame:
    """antecedent, consequent, n, support, confidence, lift of each split of an itemset into a non-empty
    antecedent and 1 or 2 consequents that meets the thresholds (on unrounded values)."""
    splits = F.filter(
        F.flatten(F.array(*[
            F.transform("items", lambda x: F.array(x)),
            *([F.flatten(F.transform("items", lambda x: F.transform(F.filter("items", lambda y: y > x), lambda y: F.array(x, y))))] if consequents > 1 else []),
        ])),
        lambda c: F.size(c) < F.size("items"),
    )
    each = sets.where(F.size("items") > 1).select("items", "n", F.explode(splits).alias("consequent")).withColumn("antecedent", F.array_except("items", "consequent"))
    of = lambda side: sets.select(F.col("items").alias(side), F.col("n").alias(f"n_{side}"))
    rows = each.join(of("antecedent"), "antecedent").join(of("consequent"), "consequent")
    confidence = F.col("n") / F.col("n_antecedent")
    out = rows.select("antecedent", "consequent", "n", (F.col("n") / n_baskets).alias("support"), confidence.alias("confidence"), (confidence / (F.col("n_consequent") / n_baskets)).alias("lift"))
    return out.where((F.col("confidence") >= min_confidence) & (F.col("lift") > min_lift))


def rule_order() -> list[Column]:
    """The order of rules in a table: falling confidence and support (in percent, one digit) and lift (two digits) as they are shown there, then the items."""
    shown = lambda c, unit: F.desc(F.floor(F.col(c) * unit + 0.5))
    return [shown("confidence", 1000), shown("support", 1000), shown("lift", 100), F.asc("antecedent"), F.asc("consequent")]


def cooccurrence(members: DataFrame, basket: str, item: str, least: int = 1) -> DataFrame:
    """a < b, n baskets that hold both, from `least` on."""
    return pairs_within(members, basket, item).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def jaccard_distances(members: DataFrame, basket: str, item: str) -> DataFrame:
    """a < b, distance 1 - n_ab / (n_a + n_b - n_ab) of items that meet in a basket (others are at 1)."""
    sizes = members.select(basket, item).distinct().groupBy(item).agg(F.count("*").alias("s"))
    rows = cooccurrence(members, basket, item)
    rows = rows.join(sizes.select(F.col(item).alias("a"), F.col("s").alias("sa")), "a").join(sizes.select(F.col(item).alias("b"), F.col("s").alias("sb")), "b")
    return rows.select("a", "b", (1 - F.col("n") / (F.col("sa") + F.col("sb") - F.col("n"))).alias("distance"))
