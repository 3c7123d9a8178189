import random
import re
from collections import Counter

from pyspark.sql import functions as F

from curatrix.llm import op4_quality_rules as op


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(windows).items() if n > 1}
    at = {i + k for i, g in enumerate(windows) if g in often for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at), len(lines),
        sum("A" <= c <= "Z" for c in t), sum("A" <= c <= "Z" or "a" <= c <= "z" for c in t), t.count("!"),
    )


def texts():
    r = random.Random(4)
    words = ["a", "b", "É", "x!", "##", "LOUD", "\xa0", "nb sp", "|"]
    return [None, "", " \n\t", "a a a a a", *("".join(r.choice(words) + r.choice([" ", "\n", "\t", "  "]) for _ in range(r.randrange(60))) for _ in range(300)), "w " * 30000]


def test_measurements_against_brute_force():
    for t in texts():
        assert op.measure_text(t) == brute(t), repr(t)[:100]


def test_ledger_policies_and_ablations(spark, docs):
    df = docs(list(enumerate(texts()))).withColumnRenamed("pieces", "n_words")
    led = op.ledger(df)
    rows = led.collect()
    for r in rows:
        m = dict(zip(op.MEASURES, brute(r["text"]), strict=True))
        bits = sum(op.BIT[x.name] for x in op.RULES if eval(x.fails.replace("OR", "or"), {}, m))  # noqa: S307
        assert r["_ledger"]["fail_bits"] == bits
    kept = op.apply_policy(df)
    mask = op.POLICIES[op.PRODUCTION]
    assert kept.columns == df.columns and kept.count() == sum(r["_ledger"]["fail_bits"] & mask == 0 for r in rows)
    for a in op.ablations(led, "prose-1").collect():
        all_bits = op.POLICIES["prose-1"]
        assert a["n_failed"] == sum(bool(r["_ledger"]["fail_bits"] & a["bit"]) for r in rows)
        assert a["n_only_here"] == sum(r["_ledger"]["fail_bits"] & all_bits == a["bit"] for r in rows)
    assert op.ledger(df.limit(0)).count() == 0


def test_clean_prose_stays(spark):
    out = op.op4_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    j = out.join(labels, "doc_id")
    good = j.where("quality = 1 AND NOT base_failed")
    assert good.where("NOT kept").count() <= 0.01 * good.count()
    bad = j.where("quality = 0")
    assert bad.where(~F.col("kept")).count() >= 0.95 * bad.count()


def test_clashing_columns_and_names_with_dots(spark):
    df = spark.createDataFrame([(1, "w " * 60, 7, 8, 9, 10)], "doc_id int, text string, _ledger int, m int, `a.b` int, c0 int")
    led = op.ledger(df)
    assert led.columns == [*df.columns, "__ledger"] and led.first()["__ledger"]["n_words"] == 60
    df = df.union(spark.createDataFrame([(2, " ".join(f"word{i}" for i in range(60)), 7, 8, 9, 10)], df.schema))
    kept = op.apply_policy(df)
    assert kept.columns == df.columns and [tuple(r)[2:] for r in kept.collect()] == [(7, 8, 9, 10)]
    clash = spark.createDataFrame([(1, "w w", "q", 5)], "n_words int, text string, TEXT string, N_Words int")
    assert op.store(clash.toDF("key", "text", "TEXT", "Key"), "key").columns[:3] == ["key", "n_words", "word_chars"]
    led = op.store(clash, "n_words")
    assert led.columns[:2] == ["n_words", "n_words"] and tuple(led.first())[:2] == (1, 2)
    dotted = df.select("_ledger", "text", "doc_id").toDF("a.b", "x.text", "k.id")
    assert op.apply_policy(dotted, text="x.text").count() == 1 and op.store(dotted, "k.id", text="x.text").count() == 2


def test_ablation_query(spark):
    rows = {(r["policy"], r["rule"]): r for r in op.quality_ablations(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == 2 + 7 + 6 and rows["prose-1", "repeated_lines"]["n_failed"] >= rows["prose-1", "repeated_lines"]["n_only_here"]
