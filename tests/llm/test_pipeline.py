from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from strandgraph.llm import decontaminate, packing, pii, toxicity
from strandgraph.llm.common import folded, shared_folder, table

from .test_text_operators import brute_groups

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_the_stages_by_brute_force(spark):
    """Each stage by a plain loop over all documents; the classifier's scores and PII codes are the models' own."""
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    scores = toxicity.op2_toxicity(spark, SF).collect()
    bad = {r["doc_id"] for r in scores if r["predicted"]}
    docs = [d for d in docs if d[0] not in bad]
    docs = [d for d, g in zip(sorted(docs), brute_groups(docs), strict=True) if g[0] == g[2]]
    items = ["".join(map(chr, folded(r["text"])[0])).strip() for r in table(spark, SF, "benchmark").collect()]
    near = {r["doc_id"] for r in decontaminate.benchmark_matches(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()}
    exact = {i for i, t in docs if any(x in "".join(map(chr, folded(t)[0])) for x in items)}
    assert exact <= near
    docs = [d for d in docs if d[0] not in near]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(frame).collect()}
    e = packing.WordEncoder(packing.public_tokenizer())
    want = {i: len(e._encode([t])[0]) // 4 + 1 for i, t in clean.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_odd_rows_go_through_run_and_checkpoints_go(spark, tmp_path):
    """Null, empty, repeated and very long texts, a null id and a clashing column through all stages; no checkpoint stays."""
    long = " ".join(f"w{i}x{i * i % 977}" for i in range(150_000))
    odd = [(-1, None), (-2, ""), (-3, "  \n "), (-4, "a row of its own, twice"), (-4, "a row of its own, twice"), (-5, long), (-6, long + " more"), (None, "a row without an id")]
    have = table(spark, SF, "documents")
    extra = [c for c in have.columns if c not in ("doc_id", "text")]
    rows = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(dict(have.dtypes)[c]).alias(c) for c in extra])
    have.unionByName(rows).withColumn("component_id", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("rdd-*"))
    got: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).where("doc_id < 0 or doc_id is null").collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
    assert set(folder.rglob("rdd-*")) <= before
    e = packing.WordEncoder(packing.public_tokenizer())
    size = lambda text: len(e._encode([text])[0]) // 4 + 1
    # -6 is a near-duplicate of -5, the smaller id of the two stays; both rows that repeat an id stay.
    assert set(got) == {None, -1, -2, -3, -4, -6}
    assert got[-1] == got[-2] == [(0, 1)]
    assert got[-3] == [(0, size("  \n "))]
    assert got[-4] == [(0, size("a row of its own, twice"))] * 2
    assert got[None] == [(0, size("a row without an id"))]
    assert sum(n for _, n in got[-6]) == size(long + " more") and len(got[-6]) > 100
