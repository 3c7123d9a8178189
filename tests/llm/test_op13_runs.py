import hashlib
import random
import zlib

import numpy as np
import pytest

from curatrix.llm import op13_periodic_runs as op


def brute_runs(w, least=6, exponent=4):
    out, n = set(), len(w)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, exponent * q):
                part = w[s : s + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def periodic(r, size):
    w = []
    while len(w) < size:
        root = [r.choice("abc") for _ in range(r.randrange(1, 6))]
        w += (root * r.randrange(1, 9))[: r.randrange(1, 30)]
        if r.random() < 0.3 and len(w) > 8:
            w += w[-r.randrange(2, 9) :] * r.randrange(1, 5)
    return w[:size]


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (4, 3), (1, 5)])
def test_runs_against_brute_force(least, exponent):
    r = random.Random(least)
    docs = [periodic(r, r.randrange(0, 60)) for _ in range(60)] + [["a"] * 40, [], ["b"], list("abaab" * 8), list("aabaabaab"), ["x"] * 5, ["x"] * 6]
    docs += [docs[3]] * 3
    names = {}
    seq = np.array([names.setdefault(x, len(names)) for w in docs for x in w], np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in docs])))
    got = op.find_runs(seq, bounds, min_length=least, min_exponent=exponent)
    assert [tuple(x) for x in got.tolist()] == [(d, *x) for d, w in enumerate(docs) for x in brute_runs(w, least, exponent)]


def test_suffix_ranks_and_lcp_against_sorted():
    r = random.Random(5)
    docs = [[r.randrange(3) for _ in range(r.randrange(0, 20))] for _ in range(8)]
    seq = np.array([x for w in docs for x in w], np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in docs])))
    doc = np.repeat(np.arange(len(docs)), np.diff(bounds))
    rounds = []
    rank = op.suffix_ranks(seq, doc, bounds[1:][doc], rounds)
    suffix = [(-d, docs[d][i - bounds[d] :]) for i, d in enumerate(doc)]
    order = sorted(range(len(seq)), key=lambda i: suffix[i])
    assert [order[k] for k in rank] == [order[k] for k in np.argsort(np.array(order))]
    lcp = op.neighbour_lcp(rank, rounds)
    for k in range(1, len(order)):
        (d, a), (e, b) = suffix[order[k - 1]], suffix[order[k]]
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) if d == e else 0
        assert lcp[k] == want


def brute(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    s, length, q = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(brute_kept(w, runs))))


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(periodic(r, r.randrange(0, 80)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (None, "a " * 9), (3, rows[3][1]), (3, "w " * 7), (204, "é\x0bé\r\né\té é é é é"), (205, "\t one  two ")]
    rows += [(i, f" a  lone text {i}\nof few words ") for i in range(300, 340)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(*x) for x in rows), key=str)


def test_long_text_empty_table_and_clashing_names(spark):
    long = " ".join(f"w{i % 7 if 1000 < i < 290_000 else i}" for i in range(300_000))
    df = spark.createDataFrame([(1, long, 1, 2), (2, "a a a a a a", 1, 2), (3, None, 1, 2)], "id int, `x.text` string, _runs int, ID int")
    out, name = op.with_runs(df, text="x.text", block_words=50)
    assert out.columns == ["id", "x.text", "_runs", "ID", "__runs"] and name == "__runs"
    got = [r[-1] for r in out.orderBy(out.columns[2]).collect()]
    got = {g["n_words"]: [tuple(x) for x in g["runs"]] for g in got}
    assert got == {300_000: [(1001, 288_999, 7)], 6: [(0, 6, 1)], 0: []}
    assert op.with_runs(df.limit(0), text="x.text")[0].collect() == []
