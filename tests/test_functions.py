"""Scalar functions against hand-computed values and plain Python."""

import hashlib
import json
import math
import random
import re
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curatrix.functions import jsonx, stats, text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()[0]


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_percentile_interpolates(spark):
    q = lambda xs, p: spark.createDataFrame([(float(x),) for x in xs], "x double").select(stats.percentile(F.col("x"), p)).first()[0]
    assert q([1, 2, 3, 4], 50) == 2.5
    assert q([0, 100], 25) == 25
    assert math.isclose(q(range(1, 101), 95), 95.05)
    assert q([42], 99) == 42
    for bad in (101, -1):
        with pytest.raises(ValueError):
            stats.percentile(F.col("x"), bad)


def test_length_stats_and_truncation(spark):
    df = spark.createDataFrame([(10,), (20,), (30,), (40,)], "n int")
    r = stats.length_stats(df, "n").first()
    assert (r["n_records"], r["mean"], r["p50"], r["max_len"]) == (4, 25.0, 25.0, 40)
    r = stats.length_stats(df.limit(0), "n").first()
    assert (r["n_records"], r["mean"], r["p99"], r["max_len"]) == (0, 0.0, 0.0, 0)
    t = {r["threshold"]: (r["n_over"], r["pct_over"]) for r in stats.truncation(spark.createDataFrame([(100,), (500,), (1500,), (5000,)], "n int"), "n", (1024, 4096, 100)).collect()}
    assert t == {1024: (2, 50.0), 4096: (1, 25.0), 100: (3, 75.0)}
    assert stats.truncation(df.limit(0), "n", (10,)).first()["pct_over"] == 0.0


def test_percentiles_selected_by_ranges(spark):
    import numpy as np

    r = random.Random(2)
    rows = [("a" if r.random() < 0.9 else r.choice(["b", None]), r.choice([r.randrange(50), r.random() * 100, None])) for _ in range(4000)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "`my group` string, v double").repartition(5)
    few, many = ({x[0]: tuple(x)[1:] for x in stats.length_stats(df, "v", ["my group"], most=m).collect()} for m in (1 << 20, 1))
    assert few == many and few["none"] == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    for g in ("a", "b", None, "one"):
        v = [x for k, x in rows if k == g and x is not None]
        assert many[g][0] == len(v) and np.allclose(many[g][2:6], np.percentile(v, [50, 90, 95, 99]), atol=1e-6)
    assert tuple(stats.length_stats(df, "v", most=1).first()) == tuple(stats.length_stats(df, "v").first())
    assert stats.length_stats(df.limit(0), "v", most=-1).first()["n_records"] == 0


def test_exact_test_and_interval(spark):
    df = spark.createDataFrame([(9, 1), (1, 9), (0, 0), (5, 5), (3000, 0)], "a bigint, b bigint")
    got = [r[0] for r in df.select(stats.mcnemar(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], 0.021484375, rel_tol=1e-9) and math.isclose(got[1], got[0]) and got[2] == 1.0 and got[3] == 1.0 and got[4] < 1e-300 + 1e-9
    lo, hi = stats.wilson(F.col("a") / F.col("b"), F.col("b"))
    rows = spark.createDataFrame([(50, 100), (500, 1000), (0, 10), (10, 10)], "a bigint, b bigint").select(lo, hi).collect()
    assert rows[0][0] < 0.5 < rows[0][1] and rows[1][1] - rows[1][0] < rows[0][1] - rows[0][0]
    assert rows[2][0] == 0.0 and math.isclose(rows[3][1], 1.0)


def test_exact_test_for_any_count(spark):
    r = random.Random(1)
    some = [(r.randrange(0, 300), r.randrange(0, 300)) for _ in range(150)] + [(4900, 5100), (1, 9999), (5000, 4990), (20, 21), (21, 22), (1, 0), (0, 40), (1, 2000)]
    got = [x[0] for x in spark.createDataFrame(some, "a bigint, b bigint").select(stats.mcnemar(F.col("a"), F.col("b"))).collect()]
    for (a, b), p in zip(some, got, strict=True):
        n, k = a + b, min(a, b)
        want = min(Fraction(1), Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n))
        assert math.isclose(p, float(want), rel_tol=1e-9, abs_tol=1e-12), (a, b)
    big = spark.createDataFrame([(10**9, 10**9 + 50_000), (10**9, 10**9)], "a bigint, b bigint").select(stats.mcnemar(F.col("a"), F.col("b"))).collect()
    # The normal limit, with a step's correction.
    assert math.isclose(big[0][0], math.erfc(49_999 / math.sqrt(2 * (2 * 10**9 + 50_000))), rel_tol=1e-6) and big[1][0] == 1.0


def weight(seed, rep, key):
    h = int(hashlib.md5(f"{seed}:{rep // 4}:{key}".encode()).hexdigest()[8 * (rep % 4) :][:8], 16)
    return sum(h >= int(x, 16) for x in stats.poisson_limits())


def test_bootstrap(spark):
    same = spark.createDataFrame([(i, i < 5, i < 5) for i in range(8)], "id int, a boolean, b boolean")
    assert tuple(stats.bootstrap_ci(same, "a", "b").first()) == (0.0, 0.0, 0.0)
    assert tuple(stats.bootstrap_ci(same.limit(0), "a", "b").first()) == (None, None, None)
    r = random.Random(3)
    rows = [(i, r.random(), r.random() if i % 9 else None) for i in range(60)]
    got = stats.bootstrap_ci(spark.createDataFrame(rows, "id int, a double, b double").repartition(7), "a", "b", reps=203, seed=5).first()
    d = {i: a - b for i, a, b in rows if b is not None}
    means = sorted(sum(weight(5, k, i) * x for i, x in d.items()) / sum(weight(5, k, i) for i in d) for k in range(203))
    assert all(map(math.isclose, got, (means[int(0.025 * 203)], means[int(0.975 * 203)], sum(d.values()) / len(d))))


def test_poisson_weights_have_mean_and_variance_one():
    w = [weight(1, k, i) for k in range(40) for i in range(500)]
    mean = sum(w) / len(w)
    assert abs(mean - 1) < 0.03 and abs(sum((x - mean) ** 2 for x in w) / len(w) - 1) < 0.05


def test_names(spark):
    names = ["ok", "a", "a" * 64, "a" * 65, "a--b", "-a", "a-", "Ab", "", "a\n", "a\r", None, "0-9"]
    want = [bool(n is not None and re.match(text.NAME_PATTERN, n) and "--" not in n) for n in names]
    assert column(spark, names, text.valid_name) == want
    assert column(spark, ["My Skill__X", "--a_b--", "É x"], text.normal_name) == ["my-skill-x", "a-b", "é-x"]


def test_paths_licences_stubs(spark):
    assert column(spark, ["a..b", "/x", "a/b", "../c", None], text.unsafe_path) == [True, True, False, True, False]
    texts = ["Apache License\nVersion 2.0", "for a limited time", "BSD", "x" * 400 + "mit", None, "CC0", "The Unlicense"]
    assert column(spark, texts, text.licence) == ["apache-2.0", "mit", "bsd", "present (unparsed)", "unknown", "cc0", "unlicense"]
    md = "---\nname: x\ndescription: deprecated compatibility entry\n---\nbody"
    assert column(spark, [md, "Status:  moved", "see deprecated compatibility entry", "fine", None], text.is_stub) == [True, True, False, False, True]


def test_markdown(spark):
    md = "---\nname: 'my-x'\ndescription: one\n---\n# Title\n\n---\n\nFirst  para\nline.\n\n## When to Use it\n- a\n* b\n2) c\nplain\n\n### Next\n- no\n## Limitations\n- never"
    body = one(spark, md, text.body)
    assert one(spark, md, lambda c: text.front_matter_field(c, "name")) == "my-x"
    assert one(spark, body, text.first_paragraph) == "First para line."
    assert one(spark, body, lambda c: text.section_items(c, text.WHEN_USE)) == ["a", "b", "c", "plain"]
    assert one(spark, body, lambda c: text.section_items(c, text.WHEN_NOT)) == ["never"]
    assert one(spark, "no heading", lambda c: text.section_items(c, text.WHEN_USE)) == []
    assert one(spark, "plain", text.body) == "plain" and one(spark, "# only", text.first_paragraph) == ""


def test_fences_and_json(spark):
    cases = ['{"a":1}', "```json\n{\"a\":1}\n```", '{"a":1} x', '{"a":1}{', "{},{}", "1],[2", "", "[]", '"s"', "null", "```\n[1]\n``` ", "not json", "```json\r\n{}\r\n```", "  {} "]
    want = []
    for c in cases:
        s = re.sub(r"^```(?:json)?\s*|\s*```$", "", c, flags=re.M).strip()
        try:
            json.loads(s)
            want.append(True)
        except ValueError:
            want.append(False)
    assert column(spark, cases, lambda c: jsonx.parsed(text.strip_fences(c)).isNotNull()) == want
    assert column(spark, ['{"a":1,"a":2}', "NaN", "{"], jsonx.exactly_parsed) == [True, True, False]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB9 é\n-_", max_size=12), min_size=1, max_size=8))
def test_tokens_match_python(spark, values):
    assert column(spark, values, text.tokens) == [re.findall("[a-z0-9]+", v.lower()) for v in values]


def test_binary_and_decoding(spark):
    rows = [bytearray(b"abc"), bytearray(b"a\x00b"), bytearray(b"x" * 5000 + b"\x00"), bytearray(b"a\xffb")]
    assert column(spark, rows, text.is_binary, "binary") == [False, True, False, False]
    assert column(spark, rows[3:], text.decoded, "binary") == ["a�b"]


def test_prompts(spark):
    df = spark.createDataFrame([("ask", None), ("ask", "ctx")], "i string, c string")
    assert [r[0] for r in df.select(text.user_content(F.col("i"), F.col("c"))).collect()] == ["ask", "ask\n\n<context>\nctx\n</context>"]
    assert df.select(text.chatml(F.array(text.message("user", F.col("i"))))).first()[0] == "<|im_start|>user\nask<|im_end|>\n"


def test_json_of_refused_rows_alone_goes_to_python(spark):
    rows = [(1, '{"a": 1}'), (2, '{"a": NaN}'), (3, '{"a": 1, "a": 2}'), (4, "{"), (5, None), (6, '{"a": 1} x')]
    df = spark.createDataFrame(rows, "id int, s string")
    whole = {r["id"]: r["v"] for r in df.select("id", F.to_json(jsonx.exactly(F.col("s"))).alias("v")).collect()}
    split = {r["id"]: r["v"] for r in jsonx.with_exactly(df, F.col("s"), "o").select("id", F.to_json("o").alias("v")).collect()}
    assert split == whole and whole[2] and whole[3] == '{"a":2}' and whole[4] is whole[5] is whole[6] is None
    plan = jsonx.with_exactly(df, F.col("s"), "o")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" in plan
