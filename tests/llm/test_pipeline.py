import re

import corpus_pipeline as cp
from curatrix.llm import op1_sentencepiece, op4_quality_rules
from curatrix.llm.entry import QUERIES
from tests_llm_brute import decontaminated, line_deduped, near_deduped


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES if q not in ("pipeline", "quality_ablations")) == list(range(1, 14))
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]


def test_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    out = cp.run(spark, sf)
    assert out.columns == [*docs.columns, "pieces"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    mask = op4_quality_rules.POLICIES[op4_quality_rules.PRODUCTION]
    fails = lambda t: sum(op4_quality_rules.BIT[x.name] for x in op4_quality_rules.RULES if eval(x.fails.replace("OR", "or"), {}, dict(zip(op4_quality_rules.MEASURES, op4_quality_rules.measure_text(t), strict=True))))  # noqa: E731, S307
    rows = [(d, t) for d, t in rows if not fails(t) & mask]
    want = decontaminated(near_deduped(line_deduped(rows)), bench)
    got = {r["doc_id"]: r for r in out.collect()}
    assert {d: r["text"] for d, r in got.items()} == dict(want)
    v = op1_sentencepiece.load_vocabulary(op1_sentencepiece.default_model())
    assert all(op1_sentencepiece.decode_ids(r["pieces"], v) == r["text"] for r in got.values() if r["text"])


def test_stages_on_awkward_tables(spark):
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 60, "en", "s", 300), (2, "word " * 60, "en", "s", 300)]
    for make in (rows, []):
        docs = spark.createDataFrame(make, schema)
        for name, stage in cp.STAGES:
            done = stage(spark, docs, sf)
            assert done.count() <= len(make)
            if name != "sentencepiece":
                assert done.columns == docs.columns and done.schema.simpleString() == docs.schema.simpleString()
