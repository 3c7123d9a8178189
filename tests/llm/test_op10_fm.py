import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import op10_decontaminate as op


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=13):
    w, hit, named = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        wins = {tuple(iw[i : i + window]) for i in range(max(1, len(iw) - window + 1))} if iw else set()
        for g in wins:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    named.add(str(item))
    return len(w), len(hit), sorted(named)


def make(seed, n=60):
    r = random.Random(seed)
    voc = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(voc) for _ in range(r.choice([1, 3, 12, 13, 14, 30])))) for i in range(8)] + [(20, ""), (21, "!!"), (22, "É ünïcode")]
    docs = []
    for i in range(n):
        t = " ".join(r.choice([*voc, "other", "É"]) for _ in range(r.randrange(60)))
        for _ in range(r.randrange(3)):
            t += f" {r.choice(items)[1].upper()}, {r.choice(voc)}"
        docs.append((i, t))
    return docs, items


@pytest.mark.parametrize("how", [{}, {"shard_words": 40}, {"block_words": 20}, {"window": 4}])
def test_against_brute_force(spark, docs, how):
    rows, items = make(3)
    rows += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (103, "v1 " * 20000)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out, found = op.find_leaks(docs(rows).withColumnRenamed("pieces", "_leaks"), bench, **how)
    assert found == "__leaks"
    got = sorted((r["doc_id"], r["n"], r["h"], r["i"]) for r in out.select("doc_id", F.col(f"{found}.n_words").alias("n"), op.n_hit(found).alias("h"), F.col(f"{found}.items").alias("i")).collect())
    short = [(d, t) for d, t in rows if d != 103]
    assert [g for g in got if g[0] != 103] == sorted((d, *brute(t, items, how.get("window", 13))) for d, t in short)


def test_suffix_array_and_ranks():
    r = np.random.default_rng(2)
    for _ in range(30):
        runs = [r.integers(1, 5, r.integers(1, 20)) for _ in range(6)]
        seq = np.concatenate([np.append(x, 0) for x in runs]).astype(np.int64)
        key = lambda i: [(0, j) if seq[j] == 0 else (1, int(seq[j])) for j in range(i, len(seq))]  # noqa: E731, B023
        assert op.suffix_array(seq).tolist() == sorted(range(len(seq)), key=key)
        tree = op.WaveletMatrix(seq, 5)
        sym, at = r.integers(0, 5, 50), r.integers(0, len(seq) + 1, 50)
        assert tree.rank(sym, at).tolist() == [int((seq[:p] == s).sum()) for s, p in zip(sym, at, strict=True)]


def test_empty_tables_and_decisions(spark, docs):
    rows, items = make(4, 5)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert op.find_leaks(docs(rows).limit(0), bench)[0].count() == 0
    out, found = op.find_leaks(docs(rows), bench.limit(0))
    assert out.where(f"size({found}.starts) > 0").count() == 0
    long = " ".join(f"clean{i}" for i in range(400))
    leak = " ".join(f"q{i}" for i in range(13))
    kept = op.decontaminate(docs([(1, long), (2, f"{long} {leak}"), (3, f"some {leak}"), (4, None)]), spark.createDataFrame([(1, leak)], "item_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]


def test_bits_and_located_positions():
    r = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 65, 1000):
        bits = r.integers(0, 2, n)
        b, at = op.Bits(bits), np.arange(n + 1)
        assert b.rank(at).tolist() == [int(bits[:i].sum()) for i in at] and b.get(at[:-1]).tolist() == bits.astype(bool).tolist()
    seq = np.concatenate([np.append(r.integers(1, 4, 40), 0) for _ in range(9)]).astype(np.int64)
    index = op.FMIndex(seq, 4)
    assert len(index.positions) < len(seq) / 4 and index.locate(np.arange(len(seq))).tolist() == op.suffix_array(seq).tolist()


def test_blocks_are_made_one_at_a_time(spark):
    bench = spark.createDataFrame([(i, f"a{i} b{i} c") for i in range(6)], "`i.d` int, `t.t` string")
    made = op.blocks(bench, item_id="i.d", text="t.t", window=2, block_words=6)
    assert not isinstance(made, list)
    got = [(b.names, [b.items(w) for w in range(len(b.windows))]) for b in made]
    assert [n for n, _ in got] == [["0", "1"], ["2", "3"], ["4", "5"]] and all(len(x) == 4 for _, x in got)


def test_clashing_columns_and_names_with_dots(spark):
    df = spark.createDataFrame([(1, "q1 q2 q3", 7, 8), (2, "other words", 9, 10)], "`k.id` int, `x.text` string, _leaks int, c1 int")
    bench = spark.createDataFrame([(1, "q1 q2 q3")], "item_id int, text string")
    out, found = op.find_leaks(df, bench, text="x.text", block_words=1)
    assert out.columns == [*df.columns, "__leaks"] and [r[found]["items"] for r in out.collect()] == [["1"], []]
    kept = op.decontaminate(df, bench, text="x.text")
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "other words", 9, 10)]
