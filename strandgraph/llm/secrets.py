"""Secret scans with corpus-wide ownership frequency.

Each text is scanned for base secrets and for looser candidates: long tokens that mix
letters and digits. Candidate values are hashed, and each hash is aggregated over the
distinct repositories (sources) and owners that hold it. A value that many owners hold is a copied
example; a value of few owners that looks random is live. Live candidates become
spans of kind `live`; base spans stay, whatever their class.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, table

# The patterns of the base spans.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
WORDS = ("passw", "secret", "token", "api")

#: A looser candidate: 20 characters or more with upper case, lower case and digits.
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
#: A value of more owners than this is a copied example; less random ones aren't live.
MOST_OWNERS, LEAST_BITS = 2, 3.0
#: The classes of values with more uses than this are broadcast: of them there is at most one for so many spans. The others' are joined by shuffle.
MANY_USES = 100_000


def entropy(value: str) -> float:
    """Bits a character, by the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base kinds, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    out.sort(key=lambda x: x[:3])
    return [(s, e, KINDS[k], v) for s, e, k, v in out]


def loose_spans(text: str) -> list[tuple[int, int, str, str]]:
    return [
        (m.start(), m.end(), "loose", m[0])
        for m in LOOSE.finditer(text)
        if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])
    ]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per row of docs: id, owner, row, found (array of start, end, kind, value hash, bits)."""

    def start():
        def work(texts):
            found = []
            for text in texts:
                text = text or ""
                spans = base_spans(text) + loose_spans(text)
                found.append([
                    {"start": s, "end": e, "kind": k, "hash": int(np.uint64(xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass"))).view(np.int64)), "bits": entropy(v)}
                    for s, e, k, v in spans
                ])
            return None, (found,)

        return work

    made = "found array<struct<start: int, end: int, kind: string, hash: bigint, bits: double>>"
    passed = {"id": id_col} | ({"owner": owner_col} if owner_col in docs.columns else {})
    rows = map_texts(docs, text_col, passed, start, made)
    if "owner" not in rows.columns:
        rows = rows.withColumn("owner", F.lit(None).cast("string"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame, most_owners: int = MOST_OWNERS, least_bits: float = LEAST_BITS) -> DataFrame:
    """hash, n_owners, n_repositories, n_uses, class of each candidate value.

    The owner of a repository is the part of its name before the first /. A null
    repository counts as one of its own name and owner.
    """
    each = (
        found.select(F.coalesce("owner", F.lit("")).alias("repository"), F.explode("found").alias("f"))
        .groupBy("f.hash", "repository").agg(F.count("*").alias("n"), F.max("f.bits").alias("bits"))
        .groupBy("hash", F.substring_index("repository", "/", 1).alias("owner")).agg(F.count("*").alias("repositories"), F.sum("n").alias("n"), F.max("bits").alias("bits"))
    )
    sums = each.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_uses"), F.max("bits").alias("bits"))
    return sums.withColumn(
        "class", F.when(F.col("n_owners") > most_owners, "example").when(F.col("bits") >= least_bits, "live").otherwise("weak")
    )


def judged(each: DataFrame, owned: DataFrame, many_uses: int = MANY_USES) -> DataFrame:
    """The rows of each with the class of their hash; no value, however much it is copied, meets in one task."""
    classes = owned.select("hash", "class", (F.col("n_uses") > many_uses).alias("many"))
    often, seldom = classes.where("many").drop("many"), classes.where("not many").drop("many")
    return each.join(F.broadcast(often), "hash").unionByName(each.join(F.broadcast(often.select("hash")), "hash", "left_anti").join(seldom, "hash"))


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", many_uses: int = MANY_USES
) -> DataFrame:
    """One row per row of docs: id, base (array of kind, start, end), extra (likewise, of kind live), n_live, n_example.

    Null and empty texts have no spans. A null or missing owner counts as one owner. Repeated rows are scanned one
    by one and make a value no more widely owned. Whole texts are scanned, of any length. An empty table gives an empty result.
    """
    found = checkpoint(candidates(docs, id_col, text_col, owner_col))
    each = found.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    classed = judged(each, checkpoint(ownership(found)), many_uses)
    base = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), "kind", "end")
    gathered = classed.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") != "loose", base))).alias("base"),
        F.array_sort(F.collect_list(F.when((F.col("class") == "live"), F.struct("start", "end")))).alias("live"),
        F.count_if(F.col("class") == "live").alias("n_live"),
        F.count_if(F.col("class") == "example").alias("n_example"),
    )
    empty = "cast(array() as array<struct<kind:string,start:int,end:int>>)"
    return found.select(F.col("id").alias(id_col), "row").join(gathered, "row", "left").select(
        id_col,
        F.coalesce(F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), F.expr(empty)).alias("base"),
        F.coalesce(F.transform(F.array_distinct("live"), lambda x: F.struct(F.lit("live").alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), F.expr(empty)).alias("extra"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def written(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = lambda x: F.struct(x["start"].alias("a"), F.array_position(F.array(*map(F.lit, [*KINDS, "live"])), x["kind"]).alias("b"), x["end"].alias("end"), x["kind"].alias("kind"))
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", "extra"), order)), lambda x: F.struct(x["kind"].alias("kind"), x["a"].alias("start"), x["end"].alias("end")))
    return spans.select(
        "doc_id", *map(count, KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written(ordered).alias("spans"), "n_live", "n_example",
    )


QUERIES = {"op9_ownership_secrets": op9_ownership_secrets}
#: Matches and the pieces between them give the places; a letter in either case is a class of two, as (?i) knows more than A-Z.
_WORD = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_BEFORE, _VALUE, _RUN = rf"""(?:{_WORD})["'']?\x20*[:=]\x20*["'']?""", "[A-Za-z0-9+/_.=-]+", "[A-Za-z0-9+/_=-]+"
_FOUND = " UNION ALL ".join(
    f"SELECT r, repository, '{kind}' AS kind, {place} AS place, {least} AS least, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS between FROM docs"
    for kind, place, least, pattern in (("assign", 1, 8, _BEFORE + _VALUE), ("access", 2, 16, "AKIA[A-Z0-9]+"), ("hex", 3, 32, "[0-9a-f]+"), ("loose", 4, 20, _RUN))
)
SQL = {
    "op9_ownership_secrets": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS repository FROM documents),
found AS ({_FOUND}),
each AS (
  SELECT r, repository, kind, place, least, hits[i] AS hit, CASE WHEN kind = 'assign' THEN regexp_extract(hits[i], '{_BEFORE}({_VALUE})', 1) ELSE hits[i] END AS v,
    coalesce(list_sum(list_transform(between[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)),
spans AS (
  SELECT r, repository, kind, place, v, s::BIGINT AS s, (s + length(hit))::BIGINT AS e FROM each
  WHERE length(v) >= least AND (kind <> 'loose' OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]'))),
letters AS (SELECT v, c, count(*) AS k FROM (SELECT v, unnest(string_split(v, '')) AS c FROM (SELECT DISTINCT v FROM spans)) GROUP BY v, c),
bits AS (SELECT v, -sum(k / length(v) * log2(k / length(v))) AS bits FROM letters GROUP BY v),
owned AS (SELECT v, count(DISTINCT split_part(repository, '/', 1)) AS owners FROM spans GROUP BY v),
judged AS (
  SELECT spans.*, CASE WHEN owners > {MOST_OWNERS} THEN 'example' WHEN bits >= {LEAST_BITS} THEN 'live' ELSE 'weak' END AS class
  FROM spans JOIN owned USING (v) JOIN bits USING (v)),
shown AS (
  SELECT r, kind, place, s, e FROM judged WHERE kind <> 'loose'
  UNION ALL SELECT DISTINCT r, 'live', 4, s, e FROM judged WHERE class = 'live'),
lines AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) FILTER (kind <> 'live') AS base,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
  FROM shown GROUP BY r),
counts AS (SELECT r, count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'example') AS n_example FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN lines USING (r) LEFT JOIN counts USING (r)
"""
}
