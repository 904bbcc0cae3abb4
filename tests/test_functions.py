import pytest
from pyspark.sql import functions as F
from strandgraph.functions import privacy as V
from strandgraph.functions import text as X

# Texts of our own, one for each rule.
NOTE = (
    "病人钱某男62岁20031234，2021年11月9日初诊。 / 2021/12/01复查；20220115摄片。 / 去年10月起咳嗽，8月2日加重。 / 2019年7月发病"
    " / 3 visits 2021-11-09..2021-12-01 / 2021.12.15二诊 / 12.28三诊 / 妹妹周某某女9岁7654321"
)
CITE = "《某某杂志》1931年5月3卷第7期"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_redaction_leaves_nothing(spark):
    rows = spark.createDataFrame([(1, NOTE), (2, CITE), (3, None), (4, ""), (5, "王五男95岁1234567。")], "id int, text string")
    done = {r["id"]: r for r in V.redact(rows, "text").withColumn("left", V.residuals(F.col("text"))).collect()}
    assert done[1]["left"] == {}
    for part in ("患者（男，62岁），2021年初诊", "2021年复查；2022年摄片", "去年起咳嗽，某日加重", "2019年发病", "3 visits over 22 days (2021)", "2021年二诊", "某日三诊", "患者（女，9岁）"):
        assert part in done[1]["text"], part
    assert done[1]["hits"]["patient_header"] == 2 and done[1]["hits"]["visit_span"] == 1
    assert done[2]["text"] == CITE and done[2]["hits"] == {}
    assert done[3]["text"] is None and done[4]["text"] == ""
    assert done[5]["text"] == "患者（男，90岁以上）。"


def test_gate(spark):
    names = V.header_names(spark.createDataFrame([(NOTE,)], "text string"))
    assert {r["name"] for r in names.collect()} == {"钱某", "周某某"}
    rows = [(1, "钱某来诊", True), (2, "钱某来诊", False), (3, "好", True), (4, "4月20日", False), (5, "4月20日", True), (6, "电话13812345678", False), (7, None, True), (8, "2020年1月2日，95岁", None), (9, "钱", True)]
    out = spark.createDataFrame(rows, "id int, text string, strict boolean")
    gate = V.privacy_gate(out, names, "id", "text", "strict")
    assert {(r["id"], r["what"], r["problem"]) for r in gate.collect()} == {(1, "derived_name", True), (2, "derived_name", False), (5, "month_day", True), (6, "phone", True)}
    with pytest.raises(V.PrivacyError):
        V.require_clean(gate)
    V.require_clean(gate.where("id in (2, 3, 4, 7, 8, 9)"))


@pytest.mark.parametrize(
    ("text", "surface", "value", "kind"),
    [
        ("生白芍五两", "白芍", 50.0, "weight"), ("桂枝木四分", "桂枝", 0.4, "weight"), ("广皮红钱半", "广皮", 1.5, "weight"), ("大枣三枚", "大枣", None, "count"),
        ("石斛（先煎）三钱五分", "石斛", 3.5, "weight"), ("石斛各二十三钱", "石斛", 23.0, "weight"), ("甘草", "甘草", None, "none"), ("甘草", "白芍", None, "notfound"),
    ],
)
def test_doses(spark, text, surface, value, kind):
    dose = one(spark, X.dose_of(F.lit(text), [surface]))[0]
    assert (dose["value"], dose["kind"]) == (value, kind)


def test_features(spark):
    row = one(
        spark, X.pulse_sides(F.lit("脉右浮滑左弦数")), X.pulse_sides(F.lit("脉小")), X.tongue_features(F.lit("舌淡红苔白腻")), X.tongue_features(F.lit("舌红少苔")),
        X.classified(F.lit("风寒咳嗽痰饮")), X.classified(F.lit("无")), X.tagged(F.lit("宣肺化痰"), X.PRINCIPLE_RULES), X.mapped(F.lit("溺短赤"), X.SYNONYMS), X.mapped(F.lit("微温"), X.QUALITIES),
    )
    assert row[0] == {"右": ["浮", "滑"], "左": ["数", "弦"]} and row[1] == {"双手": ["细"]}
    assert row[2] == ["舌淡红", "苔白", "苔腻"] and row[3] == ["舌红", "少苔/无苔"]
    assert tuple(row[4]) == ("风邪", "风寒") and tuple(row[5]) == ("未明", "")
    assert row[6] == ["宣肺疏表", "化痰豁痰"] and row[7] == "溺热" and row[8] == "温"


def test_small_functions(spark):
    row = one(
        spark, X.span_days(F.array(F.lit("2022-07-01"), F.lit("2022-07-22"), F.lit("bad"))), X.span_days(F.array().cast("array<string>")), X.year(F.lit("约1905")), X.year(F.lit("x")),
        X.capped_age(F.lit("95")), X.capped_age(F.lit("x")), X.visits(F.lit("初诊 二诊 三诊")), X.around(F.lit("abcdef"), "cd", 1), X.without_count(F.lit("咳（12）")),
        X.engines_of(F.lit("eng (a/b、c)")), X.corpus_of(F.lit("第三章 / x"), {"甲": "a"}, "z"), X.corpus_of(F.lit("甲 / x"), {"甲": "a"}), X.layer_of(F.lit("r"), F.lit("modern"), {}), X.layer_of(F.lit("r"), F.lit("b"), {"r": "case"}),
        *[X.holds_parts(F.lit(t), X.parts_of(F.lit(s))) for t, s in (("one two three", "one / three"), ("one", " / "), ("one", "one / two"))], X.six_digits(F.lit(3.14159265)), X.case_uid(F.lit("abc12345")),
    )
    assert row[0] == 21 and row[1] is None and tuple(row[2]) == (1905, True) and tuple(row[3]) == (None, None)
    assert row[4] == "90+" and row[5] is None and row[6] == 3 and row[7] == "bcde" and row[8] == "咳"
    assert [tuple(x) for x in row[9]] == [("eng", "a"), ("eng", "b"), ("eng", "c")]
    assert (row[10], row[11], row[12], row[13]) == ("z", "a", "modern_case", "case")
    assert (row[14], row[15], row[16]) == (True, True, False) and row[17] == 3.14159 and row[18] == "H1234"


def test_nfkc(spark):
    got = spark.createDataFrame([("Ａ Ｂ　c",), (None,)], "t string").select(X.nfkc("t").alias("t")).collect()
    assert [r["t"] for r in got] == ["ABc", None]


def test_long_pulse_descriptions_are_read_whole(spark):
    row = one(spark, X.pulse_sides(F.lit("脉左" + "某" * 150 + "弦")))
    assert row[0] == {"左": ["弦"]}


def test_string_leaves_at_any_depth(spark):
    rows = spark.createDataFrame([("n1", "a", [("b", "p1", {"id": "x", "k": "c"}), (None, "p2", None)], 3)], "id string, name string, items array<struct<t: string, pid: string, m: map<string, string>>>, n int")
    assert rows.select(V.string_leaves(rows).alias("x")).first()["x"] == ["a", "b", "c"]


def test_private_export(spark, tmp_path):
    from strandgraph.sources.writers import private_export, write_table

    names = spark.createDataFrame([("钱某",)], "name string")
    good, bad = spark.createDataFrame([("1", ["咳"])], "id string, x array<string>"), spark.createDataFrame([("1", ["钱某咳"])], "id string, x array<string>")
    public = str(tmp_path / "public")
    with pytest.raises(ValueError):
        private_export(good, names, f"{public}/x", public)
    with pytest.raises(V.PrivacyError):
        private_export(bad, names, str(tmp_path / "own"), public)
    private_export(good, names, str(tmp_path / "own"), public)
    assert spark.read.json(str(tmp_path / "own")).count() == 1
    report = spark.createDataFrame([(2, 'b "q"'), (1, "a,b"), (3, None)], "n int, t string")
    write_table(report, str(tmp_path / "report"), ["n"])
    (file,) = (tmp_path / "report").glob("part-*")
    assert file.read_bytes().decode("utf-8") == '\ufeffn,t\n1,"a,b"\n2,"b ""q"""\n3,\n'
