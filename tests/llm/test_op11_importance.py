import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from curatrix.llm import op11_importance as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, order=2):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, order=2, buckets=10_000, seed=7, least=20, percent=25):
    hits = [Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in grams(t, order)[1]) for texts in ([t for _, t in rows], target)]
    a, b = (sum(h.values()) + buckets for h in hits)
    gain = lambda k: math.floor(1000 * math.log((hits[1][k] + 1) * a / ((hits[0][k] + 1) * b)))
    out = []
    for d, t in rows:
        n, fs = grams(t, order)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0]))
    drawn = able[: percent * len(able) // 100]
    ranks = {id(r): i + 1 for i, r in enumerate(drawn)}
    return sorted(([*r, ranks.get(id(r))] for r in out), key=str)


def corpus(r, n, vocab):
    return [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 60)))) for i in range(n)]


def got(df):
    return sorted(([r["doc"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in df.collect()), key=str)


@pytest.mark.parametrize(("order", "buckets", "block", "part"), [(2, 10_000, 1 << 21, 1 << 20), (2, 50, 100, 300), (3, 997, 700, 1000), (1, 10, 1, 1)])
def test_against_brute_force(spark, docs, order, buckets, block, part):
    r = random.Random(order)
    vocab = ["the"] * 10 + [f"w{i}" for i in range(30)] + ["É", "don't", "A-B", "naïve", "日本", "x y", "UP"]
    rows = corpus(r, 80, vocab) + [(100, None), (101, ""), (102, " ,;"), (None, "the w1 " * 20), (103, "the " * 400), (104, "one")]
    target = ["w1 w2 w3 the w4", None, "", "É naïve " * 5]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, TEXT2 int")
    df = docs(rows).repartition(5)
    assert got(op.scores(df, goal, order=order, buckets=buckets, block_words=block, part_words=part)) == brute(rows, target, order, buckets)


def test_repeated_rows_ties_and_empty_tables(spark, docs):
    rows = [(1, "a b " * 12)] * 3 + [(2, "c d " * 12)] * 5 + [(3, "e " * 5)]
    goal = spark.createDataFrame([("a b a b",)], "text string")
    res = got(op.scores(docs(rows), goal, percent=50))
    assert sorted(x[5] for x in res if x[5]) == [1, 2, 3, 4] and {x[5] for x in res if x[0] == 3} == {None}
    none = goal.limit(0)
    assert got(op.scores(docs(rows), none, percent=0)) == brute(rows, [], percent=0)
    assert got(op.scores(docs([]).limit(0), goal)) == []


def test_resample_carries_columns(spark):
    rows = [(i, f"word{i} and " * 15, i, 2 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "`k.id` int, `x.text` string, rank int, RANK int")
    goal = spark.createDataFrame([("word3 and word7",)], "`t.t` string")
    out = op.resample(df, goal, doc_id="k.id", text="x.text", target_text="t.t")
    keep = {x[0] for x in brute([(a, b) for a, b, _, _ in rows], ["word3 and word7"]) if x[5]}
    assert out.columns == df.columns and sorted(tuple(x) for x in out.collect()) == [x for x in rows if x[0] in keep] and len(keep) == 10


def test_block_features_and_long_text(spark, docs):
    seq = [0, 1, 0, 1, 2, 0, 1]
    f = op.Features(op._pack(b"a\nb\nc"), op._pack_numbers(np.array(seq)), [5, 0, 2], 3, 4, True)
    want = Counter(f for t in ("a b a b c", "", "a b") for f in grams(t, 3)[1])
    assert dict(zip((x.decode() for x in f.texts.to_pylist()), f.counts().tolist(), strict=True)) == want
    rows = [(1, " ".join(f"w{i % 50_000}" for i in range(300_000))), (2, "w1 w2 w3")]
    goal = spark.createDataFrame([("w1 w2",)], "text string")
    assert got(op.scores(docs(rows), goal)) == brute(rows, ["w1 w2"])
