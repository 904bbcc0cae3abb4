"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Chinese numerals, dose units in qian, classification and feature rules.
NUMERALS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
UNITS = {"钱": 1.0, "两": 10.0, "分": 0.1}
DOSE = r"^([一二三四五六七八九十两]*)(钱|两|分)(半)?(?:([一二三四五六七八九十]+)分)?"
COUNT = r"^([一二三四五六七八九十百卅廿两]+)\s*小?(枚|个|片|朵|支|尺|寸|帚|张|对|粒|匙|只|茎|扎|颗|盅|瓢|滴)"
NOTE = r"^\s*(?:[（(][^）)]{0,6}[）)]|\[\]|各)\s*"
TYPE_RULES = [
    ("专病", r"顿咳|肺痈|脓血"),
    ("虚劳", r"劳|痨|阴虚|肾咳|由肾传肺|肾虚|久咳成"),
    ("肝火", r"肝|木侮|木火|刑金|侮金"),
    ("湿热", r"湿热|湿温|暑湿|湿阻|酒湿|夹湿|湿滞|酒毒"),
    ("风邪", r"风寒|风热|风燥|风嗽|伤风|冬温|秋燥|受寒"),
    ("肺热", r"肺热|肺火|伏火|热痰|痰火|肺燥"),
    ("痰饮", r"痰饮|寒饮|痰湿|痰阻|痰瘀|痰嗽|气逆|痰喘|气急|咳喘|痰浊"),
]
TYPE_OTHER = "未明"
PRINCIPLE_RULES = [
    ("宣肺疏表", r"宣|疏|散|透|达表|解表|轻清|开泄|开达|辛"),
    ("肃肺降气", r"肃|降|顺气|下气|平喘|镇逆|纳气"),
    ("化痰豁痰", r"痰|化饮|涤饮"),
    ("清肺泄热", r"清肺|肃清|泻肺|清金|清痰|清上|清降|泄热|清热|清化|清宣|清燥|保肺|清肃|凉"),
    ("润燥养阴", r"润|燥|养阴|滋|救肺|生津|涵|填|育阴|甘寒"),
    ("清肝平肝", r"肝|熄风|息风|潜阳|涵木"),
    ("宁络止血", r"宁络|止血|络|血"),
    ("芳化淡渗", r"芳|淡|渗|湿|分消|宣化"),
    ("和胃调中", r"胃|调中|和中|开胃|消食|健脾|醒脾"),
    ("补益扶正", r"补|益气|扶正|培|固|健|养"),
]
SPUTUM_RULES = [
    ("痰白", r"白痰|痰白|稀白|白沫|白粘|吐白"),
    ("痰黄", r"黄痰|痰黄|黄稠|吐黄|黄白"),
    ("痰中带血", r"血|带红"),
    ("痰稠粘", r"稠|粘|胶|浓"),
    ("痰稀", r"稀|沫"),
    ("咯痰不爽", r"不爽|不出|难"),
    ("痰多", r"痰多|甚多|多痰|痰甚"),
    ("干咳少痰", r"干咳|无痰|痰少|咳少痰"),
]
PULSES = "浮沉数迟滑涩弦紧细缓软弱虚大洪芤搏滞"
SYNONYMS = {"肢懈无力": "肢懈", "溺短热": "溺热", "溺赤热": "溺热", "溺黄热": "溺热", "溺短赤": "溺热", "胃不健": "胃钝", "胃纳不健": "胃钝", "胸胁痛": "胁痛", "头晕目眩": "头晕"}
QUALITIES = {"微寒": "寒", "大寒": "寒", "微温": "温", "大温": "温", "大热": "热", "微凉": "凉"}


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC without white space: Spark has no built-in form of it."""
    return s.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_parts(s: pd.Series) -> pd.Series:
    """The non-blank parts of a sentence, split at " / ", each as nfkc() leaves it."""
    return s.map(lambda t: None if t is None else ["".join(unicodedata.normalize("NFKC", p).split()) for p in t.split(" / ") if p.strip()])


def parts_of(sentence: Column) -> Column:
    """The non-blank parts of a sentence, split at " / "."""
    return F.filter(F.split(sentence, " / "), lambda p: F.trim(p) != "")


def holds_parts(text: Column, parts: Column) -> Column:
    """Whether every part is in the text; true without parts."""
    return F.forall(parts, lambda p: text.contains(p))


def around(text: Column, word: str, reach: int = 80) -> Column:
    """The characters up to `reach` before and after the first occurrence of a word; null without one."""
    at = F.instr(text, word)
    low = F.greatest(F.lit(1), at - reach)
    return F.when(at > 0, F.substring(text, low, at + len(word) + reach - low))


def visits(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit("[二三四五六七八九十]诊")) + 1)


def looked_up(c: Column, table: dict) -> Column:
    """The table's entry; null if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c) if table else F.lit(None).cast("string")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def digit(c: Column) -> Column:
    """The value of one numeral, 0 for another character."""
    return F.coalesce(looked_up(c, NUMERALS), F.lit(0))


def numeral(c: Column) -> Column:
    """A Chinese numeral up to 99; 1 if empty, 0 if it isn't one."""
    tens, ones = F.substring_index(c, "十", 1), F.substring_index(c, "十", -1)
    large = F.when(tens == "", 10).otherwise(10 * F.when(digit(tens) == 0, 1).otherwise(digit(tens))) + F.when(ones == "", 0).otherwise(digit(ones))
    return F.when(c == "", 1).when(c.contains("十"), large).otherwise(digit(c))


def dose_at(rest: Column) -> Column:
    """struct(value, kind) of a dose at the start of a text: weight in qian, or count with no value; kind null if neither."""

    def read(parts: Column) -> Column:
        number, unit, half, tenths = (parts[i] for i in range(4))
        weight = (unit != "") & ((number != "") | (half != "") | (unit == "钱"))
        size = looked_up(unit, UNITS)
        value = numeral(number) * size + F.when(half != "", 0.5 * size).otherwise(0.0) + F.when(tenths != "", numeral(tenths) * 0.1).otherwise(0.0)
        return F.struct(F.when(weight, F.round(value, 3)).alias("value"), F.when(weight, "weight").when(parts[4] != "", "count").alias("kind"))

    return let(F.array(*[F.regexp_extract(rest, DOSE, i) for i in range(1, 5)], F.regexp_extract(rest, COUNT, 1)), read)


def dose_of(sentence: Column, surfaces: Iterable[str]) -> Column:
    """struct(value, kind) of the dose after the first surface form that the sentence holds.

    Up to three notes and then up to two characters that aren't numerals may stand between.
    kind: weight, count, none (no dose there) or notfound.
    """
    none = lambda kind: F.struct(F.lit(None).cast("double").alias("value"), F.lit(kind).alias("kind"))

    def after(rest: Column) -> Column:
        tries = F.array(rest, F.regexp_replace(_skipped(rest, 1), NOTE, ""), F.regexp_replace(_skipped(rest, 2), NOTE, ""))
        found = F.filter(F.transform(tries, dose_at), lambda x: x["kind"].isNotNull())
        return F.coalesce(F.get(found, 0), none("none"))

    fixed = F.translate(sentence, "浅辆", "钱两")
    out = none("notfound")
    for name in reversed(list(surfaces)):
        rest = F.substring(fixed, F.instr(fixed, name) + len(name), F.length(fixed))
        for _ in range(3):
            rest = F.regexp_replace(rest, NOTE, "")
        out = F.when(F.instr(fixed, name) > 0, let(rest, after)).otherwise(out)
    return out


def _skipped(rest: Column, n: int) -> Column:
    """The text without n leading Chinese characters that aren't numerals; empty if there are fewer."""
    return F.regexp_extract(rest, rf"^(?:(?![一二三四五六七八九十两半钱分卅廿百])[一-龥]){{{n}}}(.*)$", 1)


def usage_flags(sentence: Column, raw: Column) -> Column:
    """struct(fresh, decocted, mixed)."""
    where = F.position(raw, sentence)
    before = F.substring(sentence, F.greatest(F.lit(1), where - 3), F.least(F.lit(3), where - 1))
    return F.struct(((where > 0) & before.contains("鲜")).alias("fresh"), sentence.rlike("先用|代水|煎汤").alias("decocted"), sentence.contains("拌").alias("mixed"))


def classified(text: Column, rules=TYPE_RULES, other: str = TYPE_OTHER) -> Column:
    """struct(type, match) of the first rule, by order, that matches."""
    out = F.struct(F.lit(other).alias("type"), F.lit("").alias("match"))
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.struct(F.lit(name).alias("type"), F.regexp_extract(text, pattern, 0).alias("match"))).otherwise(out)
    return out


def tagged(text: Column, rules) -> Column:
    """The names of all rules that match, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules]))


def features(segment: Column, letters: str) -> Column:
    return F.array_compact(F.array(*[F.when(segment.contains(x), F.lit(x)) for x in letters]))


def pulse_sides(name: Column) -> Column:
    """map of side (左, 右, 双手) to the pulse features named there."""
    s = F.translate(F.regexp_replace(F.regexp_replace(name, "^脉", ""), "[，,、。；;（）()]", ""), "小濡", "细软")
    head = F.regexp_extract(s, "^([^左右]*)", 1)
    sides = F.regexp_extract_all(s, F.lit("[左右][^左右]*"), F.lit(0))
    parts = F.concat(F.when((head != "") | (F.size(sides) == 0), F.array(F.concat(F.lit("双"), head))).otherwise(F.array().cast("array<string>")), sides)
    sided = F.transform(parts, lambda p: F.struct(F.when(p.startswith("双"), "双手").otherwise(F.substring(p, 1, 1)).alias("side"), features(F.substr(p, F.lit(2)), PULSES).alias("f")))
    each = lambda side: F.array_distinct(F.flatten(F.transform(F.filter(sided, lambda x: x["side"] == side), lambda x: x["f"])))
    return F.map_filter(F.create_map(*[x for side in ("左", "右", "双手") for x in (F.lit(side), each(side))]), lambda k, v: F.size(v) > 0)


def tongue_features(name: Column) -> Column:
    has_coat = name.contains("苔")
    body = F.replace(F.when(has_coat, F.substring_index(name, "苔", 1)).otherwise(name), F.lit("舌"), F.lit(""))
    coat = F.when(has_coat, F.substring(name, F.instr(name, "苔") + 1, F.length(name))).otherwise(F.lit(""))
    pale = body.contains("淡红")
    rest = F.replace(body, F.lit("淡红"), F.lit(""))
    return F.array_compact(F.array(
        F.when(pale, F.lit("舌淡红")),
        *[F.when(rest.contains(c), F.lit("舌" + c)) for c in "红绛淡紫"],
        F.when(name.contains("无苔") | name.contains("少苔") | name.contains("光"), F.lit("少苔/无苔")),
        *[F.when(coat.contains(c), F.lit("苔" + c)) for c in "白黄灰黑薄厚腻滑燥润糙"],
        *[F.when((coat == "") & rest.contains(c), F.lit("舌" + c)) for c in "燥润"],
    ))


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's entry, else the value itself."""
    return F.coalesce(looked_up(c, table), c)


def flavour_base(c: Column) -> Column:
    return F.regexp_replace(c, "^微", "")


def year(c: Column) -> Column:
    """struct(year, circa) of a text like 1860 or 约1905; nulls otherwise."""
    parsed = F.regexp_extract(c, r"^(约)?\s*(\d{4})$", 2)
    return F.struct(F.nullif(parsed, F.lit("")).cast("int").alias("year"), F.when(parsed != "", c.startswith("约")).alias("circa"))


def span_days(dates: Column) -> Column:
    """Days from the first to the last valid date of an array of texts; null without any."""
    valid = F.filter(F.transform(dates, lambda x: F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd")), lambda x: x.isNotNull())
    return F.date_diff(F.array_max(valid), F.array_min(valid))


def capped_age(c: Column) -> Column:
    age = c.try_cast("int")
    return F.when(age >= 90, "90+").otherwise(age.cast("string"))


def case_uid(pid: Column) -> Column:
    return F.concat(F.lit("H"), F.substring(pid, 4, 4))


def without_count(c: Column) -> Column:
    return F.regexp_replace(c, r"[（(]\d+[）)]$", "")


def six_digits(c: Column) -> Column:
    """Six significant digits."""
    return F.format_string("%.6g", c).cast("double")


def root_of(chapter_path: Column) -> Column:
    return F.trim(F.substring_index(chapter_path, " / ", 1))


def corpus_of(chapter_path: Column, corpora: dict[str, str], numbered: str = "") -> Column:
    """The corpus of a chapter's root; numbered chapters have one of their own; empty if unknown."""
    root = root_of(chapter_path)
    return F.coalesce(looked_up(root, corpora), F.when(root.rlike("^第[一二三四五六七八九十]+章"), F.lit(numbered)), F.lit(""))


def layer_of(relation: Column, corpus: Column, layers: dict[str, str], modern: str = "modern", default: str = "lineage") -> Column:
    return F.when(corpus == modern, "modern_case").otherwise(F.coalesce(looked_up(relation, layers), F.lit(default)))


def engines_of(meta: Column) -> Column:
    """array of struct(engine, layer) from "name (a/b、c)"."""
    layers = F.filter(F.split(F.regexp_extract(meta, r"\(([^)]*)\)", 1), "[/、]"), lambda x: F.trim(x) != "")
    name = F.trim(F.substring_index(meta, "(", 1))
    return F.transform(layers, lambda x: F.struct(name.alias("engine"), F.trim(x).alias("layer")))

