"""Cohorts of cases: who is a candidate, included, excluded; artefacts; coverage by a property table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import percent


def cohort(cases: DataFrame, pattern: str, title: str = "title", diagnoses: str = "diagnoses", symptoms: str = "symptoms", used: str = "used") -> DataFrame:
    """cases with candidate, included, excluded and extended.

    A candidate matches the pattern in its title or a diagnosis; it is included if `used` is true, else excluded. The
    extended cohort also takes cases that match by a symptom only, if used. Nulls match nothing and count as not used.
    """
    any_of = lambda c: F.coalesce(F.exists(c, lambda x: F.coalesce(x.rlike(pattern), F.lit(False))), F.lit(False))
    named = F.coalesce(F.col(title).rlike(pattern), F.lit(False)) | any_of(diagnoses)
    has = F.coalesce(F.col(used), F.lit(False))
    return cases.withColumns({"candidate": named, "included": named & has, "excluded": named & ~has, "extended": (named | any_of(symptoms)) & has})


def without_artefacts(rows: DataFrame, raw: str, sentence: str, artefacts: list[tuple[str, str]]) -> DataFrame:
    """rows but those whose raw value is an artefact's and whose sentence holds the phrase it was cut from. artefacts: a few (raw, phrase) rules."""
    for value, phrase in artefacts:
        hit = (F.col(raw) == value) & F.col(sentence).contains(phrase)
        rows = rows.where(~F.coalesce(hit, F.lit(False)))
    return rows


def looked_up(counts: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """counts with the columns of properties (one row a key) and known: whether the key is there. Unknown keys stay, with nulls."""
    return counts.join(properties.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def coverage(found: DataFrame, n: str = "n") -> DataFrame:
    """Of looked_up rows: keys, known_keys, uses, covered uses, share of these (%)."""
    known = F.coalesce(F.sum(F.when(F.col("known"), F.col(n))), F.lit(0))
    total = F.coalesce(F.sum(n), F.lit(0))
    return found.agg(F.count("*").alias("keys"), F.count_if("known").alias("known_keys"), total.alias("uses"), known.alias("covered"), percent(known, total).alias("share"))
