"""De-identification of case notes, and what is left of personal data afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..operators.graph import cut

# The patterns of headers, dates, numbers and ages. (?U): Unicode digits and spaces.
CJK = "一-龥"
_Y, _M, _D = r"((?:19|20)\d{2})", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_NOT_DAY = r"(?!\s*[\d日号卷期版册页])"
_WHO = rf"(?U)(?:姐姐|妹妹|哥哥|弟弟|患者|病人)?([{CJK}]{{1,4}}?)\s*"
_OLD, _YOUNG = r"0?9\d|[1-9]\d\d", r"\d{1,3}"
_RECORD = r"\s*岁\s*\d{7,8}(?!\d)"
HEADER = rf"{_WHO}([男女])?\s*(\d{{1,3}}){_RECORD}"
HEADERS = [
    (rf"{_WHO}([男女])\s*(?:{_OLD}){_RECORD}", "患者（$2，90岁以上）"),
    (rf"{_WHO}([男女])\s*0*({_YOUNG}){_RECORD}", "患者（$2，$3岁）"),
    (rf"{_WHO}(?:{_OLD}){_RECORD}", "患者（90岁以上）"),
    (rf"{_WHO}0*({_YOUNG}){_RECORD}", "患者（$2岁）"),
]
SPAN = r"(?U)(\d+)\s*visits?\s*((?:19|20)\d{2})-(\d{1,2})-(\d{1,2})\s*\.\.\s*((?:19|20)\d{2})-(\d{1,2})-(\d{1,2})"
EMPTY_SPAN = r"(?U)(\d+)\s*visits?\s*\.\."
DATES = [
    (rf"(?U){_Y}\s*年\s*{_M}\s*[月年]\s*{_D}\s*[日号]", "$1年"),
    (rf"(?U){_Y}\s*年\s*{_M}\s*月\s*{_D}{_NOT_DAY}", "$1年"),
    (rf"(?U)(?<!\d){_Y}[-/.]{_M}[-/.]{_D}(?!\d)", "$1年"),
    (rf"(?U)(?<!\d){_Y}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?!\d)", "$1年"),
    (rf"(?U){_Y}\s*年\s*{_M}\s*月(?!\s*\d)", "$1年"),
    (rf"(?U)(?<![年\d]){_M}\s*月\s*{_D}\s*[日号]", "某日"),
    (r"(?U)(去年|今年|前年|上年)\s*\d{1,2}\s*月", "$1"),
]
_BEFORE_VISIT = r"\s*[日号]?(?=\s*[：:]?\s*[初复一二三四五六七八九十]+诊)"
VISIT_DATE = rf"(?U)(?<!\d)(?:(\d{{2,5}})\s*[.．/年-]\s*)?{_M}\s*[.．/月-]\s*{_D}{_BEFORE_VISIT}"
VISIT_DATES = [
    (rf"(?U)(?<!\d){_Y}\d?\s*[.．/年-]\s*{_M}\s*[.．/月-]\s*{_D}{_BEFORE_VISIT}", "$1年"),
    (VISIT_DATE, "某日"),
]
RECORD = (r"(?U)(?<![\d.])\d{7,8}(?![\d.])", "〔编号已删〕")
# An age that is already told as 90 or more stays as it is.
AGE = (r"(?U)(?<!\d)(9\d|1\d\d)\s*岁(?!以上)", "90岁以上")
RESIDUAL = {
    "patient_header": HEADER,
    "full_date": "|".join([DATES[0][0], *[p.removeprefix("(?U)") for p, _ in DATES[1:4]]]),
    "month_day": DATES[5][0],
    "visit_date": VISIT_DATE,
    "record_number": RECORD[0],
    "national_id": r"(?U)(?<!\d)\d{17}[\dXx](?!\d)",
    "phone": r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)",
    "age_90_plus": AGE[0],
}


def spans_told(text: Column) -> Column:
    """Spans of visits as their number and days, or without days if a date isn't valid."""

    def told(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m, SPAN, i)
        day = lambda i: F.try_to_date(F.concat_ws("-", part(i), F.lpad(part(i + 1), 2, "0"), F.lpad(part(i + 2), 2, "0")), "yyyy-MM-dd")
        days = F.date_diff(day(5), day(2)).cast("string")
        known = F.concat(part(1), F.lit(" visits over "), days, F.lit(" days ("), part(2), F.lit(")"))
        return F.coalesce(known, F.concat(part(1), F.lit(" visits ("), part(2), F.lit(")")))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)))
    return F.aggregate(found, text, lambda done, m: F.replace(done, m, told(m)))


def redact(rows: DataFrame, text_col: str, hits_col: str = "hits") -> DataFrame:
    """rows with headers, visit spans, dates, record numbers and high ages of the text told less exactly, and
    a map of the rules that matched to their number, each counted on the text as that step finds it.

    Null stays null, with no hits. Each step is a projection of its own, so that no step's text is computed twice.
    """
    steps = [("patient_header", p, to) for p, to in HEADERS]
    steps += [("visit_span", SPAN, None), ("visit_span", EMPTY_SPAN, "$1 visits")]
    steps += [("date", p, to) for p, to in [*DATES, *VISIT_DATES]] + [("record_number", *RECORD), ("age_90_plus", *AGE)]
    names = rows.columns
    out = rows.withColumn("__t", F.col(text_col))
    for i, (_, pattern, to) in enumerate(steps):
        text = spans_told(F.col("__t")) if to is None else F.regexp_replace("__t", F.lit(pattern), F.lit(to))
        out = out.withColumns({f"__n{i}": F.coalesce(F.regexp_count("__t", F.lit(pattern)), F.lit(0)), "__t": text})
    hits = {}
    for i, (rule, _, _) in enumerate(steps):
        hits[rule] = hits[rule] + F.col(f"__n{i}") if rule in hits else F.col(f"__n{i}")
    every = F.create_map(*[x for k, n in hits.items() for x in (F.lit(k), n)])
    kept = [F.col("__t").alias(n) if n == text_col else F.col(n) for n in names]
    return out.select(*kept, F.map_filter(every, lambda k, n: n > 0).alias(hits_col))


def residuals(text: Column) -> Column:
    """map of the residual patterns that the text still holds to their number."""
    counts = F.create_map(*[x for k, p in RESIDUAL.items() for x in (F.lit(k), F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)))])
    return F.map_filter(counts, lambda k, n: n > 0)


def header_names(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct names of two letters or more in patient headers; for checks in memory, never to be written."""
    names = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(HEADER), F.lit(1))).alias("name")
    return texts.select(names).where(F.length("name") >= 2).distinct()


#: What no output may hold; the other patterns and names count in strict texts only.
ANYWHERE = ("patient_header", "national_id", "phone")


def privacy_gate(outputs: DataFrame, names: DataFrame, id_col: str, text_col: str, strict_col: str) -> DataFrame:
    """id, what, n, problem of what is left. Headers, national ids and phone numbers are a problem in every text; dates, record numbers
    and ages in strict ones, and are no finding elsewhere; names are a problem in strict texts and a warning (problem false) in others."""
    strict = F.coalesce(F.col(strict_col), F.lit(False))
    left = outputs.select(id_col, strict.alias("__strict"), F.explode(residuals(F.col(text_col))).alias("what", "n"))
    left = left.where(F.col("__strict") | F.col("what").isin(*ANYWHERE)).select(id_col, "what", "n", F.lit(True).alias("problem"))
    # Names and texts meet by a name's first two letters, and only such pairs are compared in full.
    letters = F.transform(F.sequence(F.lit(1), F.length("__text") - 1), lambda i: F.substr(F.col("__text"), i, F.lit(2)))
    texts = outputs.select(F.col(id_col).alias("__id"), strict.alias("__strict"), F.col(text_col).alias("__text")).where(F.length("__text") >= 2)
    pairs = texts.select("__id", "__strict", F.explode(F.array_distinct(letters)).alias("__key")).join(names.select("name", F.substring("name", 1, 2).alias("__key")), "__key")
    named = pairs.drop("__key").distinct().join(texts, ["__id", "__strict"]).where(F.col("__text").contains(F.col("name"))).groupBy("__id", "__strict").agg(F.count_distinct("name").cast("int").alias("n"))
    return left.union(named.select("__id", F.lit("derived_name"), "n", "__strict"))


#: Fields of records that hold ids, which aren't texts.
ID_FIELDS = ("id", "subject_id", "object_id", "passage_id", "pid")


def string_leaves(records: DataFrame, skip: tuple[str, ...] = ID_FIELDS) -> Column:
    """array of the non-empty strings at any depth of a record's structs, arrays and maps, fields of ids left out."""
    none = F.array().cast("array<string>")

    def leaves(value: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType):
            return F.when(value != "", F.array(value)).otherwise(none)
        if isinstance(kind, StructType):
            return F.concat(none, *[F.coalesce(leaves(value[f.name], f.dataType), none) for f in kind if f.name not in skip])
        if isinstance(kind, ArrayType):
            return F.coalesce(F.flatten(F.transform(value, lambda x: F.coalesce(leaves(x, kind.elementType), none))), none)
        if isinstance(kind, MapType):
            kept = F.map_filter(value, lambda k, v: ~k.isin(*skip)) if isinstance(kind.keyType, StringType) else value
            return leaves(F.map_values(kept), ArrayType(kind.valueType))
        return none

    return F.concat(none, *[F.coalesce(leaves(F.col(f"`{f.name}`"), f.dataType), none) for f in records.schema if f.name not in skip])


def json_leaves(rows: DataFrame, id_col: str, json_col: str, skip: tuple[str, ...] = ID_FIELDS) -> DataFrame:
    """id, path, text: the non-empty strings at any depth of JSON texts whose fields may differ by row, fields of ids left out.

    Each round opens the objects and arrays of one level, so there are as many rounds as levels. Null texts and texts that aren't
    JSON have none; a text that is one string is its own leaf. A repeated row gives its leaves again.
    """
    spark = rows.sparkSession
    now = cut(rows.select(F.col(id_col), F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v")).where("v is not null"))
    out = None
    while True:
        kind = F.schema_of_variant("v")
        found = now.where(kind == "STRING").select(id_col, "path", F.col("v").cast("string").alias("text")).where("text <> ''")
        out = found if out is None else out.union(found)
        inner = now.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        path = F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))
        now = cut(opened.where(F.col("key").isNull() | ~F.col("key").isin(*skip)).select(id_col, path.alias("path"), F.col("value").alias("v")))
        if now.isEmpty():
            return out


class PrivacyError(Exception):
    """Outputs that still hold personal data."""


def require_clean(gate: DataFrame) -> None:
    """Raises if the gate holds a problem: to be called before anything is written."""
    found = gate.where("problem").groupBy("what").agg(F.sum("n").alias("n")).collect()
    if found:
        raise PrivacyError(", ".join(f"{r['what']}: {r['n']}" for r in sorted(found)))
