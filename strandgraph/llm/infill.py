"""Fill-in-middle transformation.

A pandas UDF over Arrow batches cuts each text at two unit boundaries that a seed of its document gives, and puts the
suffix before the middle. finditer of the regex library leaves the unit ends in a compact array, two lookups there slice
the text. A second UDF rebuilds texts from outputs and forms alone.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import table

# Units, markers and shares of the forms.
UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

MADE = StructType().add("n", LongType()).add("form", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType()).add("output", StringType())
DIGESTS = StructType().add("output_sha256", StringType()).add("restored_sha256", StringType())


def seeds(doc_id: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(doc_id: str, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    ends = array("I", [0])
    ends.extend(m.end() for m in UNIT.finditer(text))
    n = len(ends) - 1
    h1, h2, h3, h4 = seeds(doc_id)
    if not text or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[a], ends[b]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text of an output. Texts with markers are plain, and no marker begins as another ends, so the first of each kind is the one put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, cut = output.index(second), output.index(MIDDLE)
    parts = {first: output[len(first) : at], second: output[at + len(second) : cut]}
    return parts[PREFIX] + output[cut + len(MIDDLE) :] + parts[SUFFIX]


@F.pandas_udf(MADE)
def transformed(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = [transform(i, t) for i, t in zip(ids, texts, strict=True)]
    made = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
    return made.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


@F.pandas_udf(StringType())
def restored(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype="object")


@F.pandas_udf(DIGESTS)
def digests(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
    """Hex SHA-256 of each output and of the text rebuilt from it."""
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    rows = [(sha(o), sha(restore(o, f))) for o, f in zip(outputs, forms, strict=True)]
    return pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n (units), form, prefix_chars, middle_chars (null if plain), output.

    A null text is empty, and an empty one plain without units. A null id seeds as an empty one. Rows that repeat an id and a text
    give the same output; rows of one id are cut by the same seed. Texts of any length are read whole, an
    empty table gives an empty result, other columns of docs are left aside.
    """
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    made = transformed(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
    return docs.select(F.col(id_col), made.alias("made")).select(id_col, "made.*")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("d", digests("output", "form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.output_sha256", "d.restored_sha256")


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
SQL = {
    "op11_fill_in_middle": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
seeded AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
    ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM docs),
placed AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
      WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM seeded),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM placed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
}
