"""The property graph: typed nodes and typed edges as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = "array<struct<chapter_path string, source_sentence string, passage_id string, evidence_verbatim boolean>>"
NODE_SCHEMA = f"id string, cls string, name string, aliases array<string>, attrs map<string,string>, provenance {PROVENANCE}, n_mentions int, n_provenance int, x double, y double, component int"
EDGE_SCHEMA = (
    "type string, subject_id string, object_id string, subject_name string, object_name string, n_support int, layer string, corpus string, "
    "source_sentence string, chapter_path string, passage_id string, evidence_verbatim boolean, evidence_in_passage boolean, "
    "engine string, agreement string, dose string, dose_note string, role string, condition string"
)
PASSAGE_SCHEMA = "pid string, source string, text string, n_chars int"
CLASS_SCHEMA = "cls string, attrs array<string>, undeclared_attrs array<string>"
PROPERTY_SCHEMA = "type string, domain string, range string, card string"


@dataclass(frozen=True)
class Graph:
    """nodes need id, cls, name; edges need type, subject_id, object_id. An edge's key is (subject_id, object_id, type).

    once: edges hold each key once by their making, so that nothing needs to fold them again. parts: the edges of each type by themselves, if
    edges are their union; plans on one type are then simplified as they aren't through a union.
    """

    nodes: DataFrame
    edges: DataFrame
    once: bool = False
    parts: dict[str, DataFrame] | None = None

    def of(self, *classes: str) -> DataFrame:
        return self.nodes.where(F.col("cls").isin(*classes))

    def typed(self, *types: str) -> DataFrame:
        if self.parts is None:
            return self.edges.where(F.col("type").isin(*types))
        own = [self.parts[t] for t in dict.fromkeys(types) if t in self.parts]
        return reduce(DataFrame.union, own) if own else self.edges.limit(0)


def attr(name: str, attrs: str = "attrs") -> Column:
    """An attribute, null where it is missing. Of a map made from columns the planner keeps the one column, and filters on it reach the files."""
    return F.col(attrs)[name]


def filled(c: Column) -> Column:
    """The text, null if it is empty: what a coalesce over possibly empty fields needs."""
    return F.nullif(c, F.lit(""))


def first_filled(*chain: Column) -> Column:
    """The first text of a chain that is neither null nor empty, else empty."""
    return F.coalesce(*map(filled, chain), F.lit(""))
