import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from curatrix.llm import op12_substring_dedup as op

LOW = -(2**63)


def split(text):
    return (text or "").encode().split()


def brute(rows, window=20):
    """[(words, kept words)] for rows (id, text); ids differ, or texts of one id are equal."""
    first = {}
    for d, t in sorted(rows, key=lambda r: LOW if r[0] is None else r[0]):
        w = split(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = []
    for d, t in rows:
        w = split(t)
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (d, i) for k in range(i, i + window)}
        out.append((w, [x for k, x in enumerate(w) if k not in gone]))
    return out


def corpus(r, n, least=0, most=90, vocab="abcdefgh"):
    pool = [[r.choice(vocab) for _ in range(r.randrange(15, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        size = r.randrange(least, most)
        while len(w) < size:
            w += r.choice(pool) if r.random() < 0.4 else [f"{r.choice(vocab)}{r.randrange(40)}" for _ in range(r.randrange(1, 25))]
            if r.random() < 0.15:
                w += ["x", "y"] * r.randrange(5, 30)
        rows.append((i, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    return rows


def run(df, **how):
    out, name = op.dedup(df, **how)
    return sorted(((r[0], r[name]["n_words"], sum(r[name]["ends"]) - sum(r[name]["starts"]), r[name]["kept"]) for r in out.collect()), key=str)


def want(rows, window=20):
    return sorted(((d, len(w), len(w) - len(k), b" ".join(k).decode()) for (d, _), (w, k) in zip(rows, brute(rows, window), strict=True)), key=str)


@pytest.mark.parametrize("window", [20, 9])
def test_against_brute_force(spark, docs, window):
    r = random.Random(window)
    rows = corpus(r, 120)
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[3][1]), (503, rows[3][1]), (503, rows[3][1]), (504, "z " * 19), (505, "z " * 20), (506, "z " * 21), (7, rows[7][1]), (508, "é à " * 30)]
    assert run(docs(rows).repartition(5), window=window) == want(rows, window)


def test_hot_passage_over_many_partitions(spark, docs):
    hot = " ".join(f"h{i}" for i in range(70))
    rows = [(i, f"own{i} words{i} " * (i % 3) + hot + f" tail{i}") for i in range(600)] + [(1000 + i, hot) for i in range(50)]
    assert run(docs(rows).repartition(16)) == want(rows)
    paths = op.repeated_paths(docs(rows).repartition(16)).collect()
    assert [(p["doc"], p["start"], p["words"], p["copies"]) for p in paths] == [(0, 0, 70, 601)]


def test_paths_against_windows(spark, docs):
    r = random.Random(3)
    rows = [(d, t) for d, t in corpus(r, 80, 30, 120) if t]
    rows = list({t: (d, t) for d, t in reversed(rows)}.values())
    got = op.repeated_paths(docs(rows)).collect()
    texts = {d: split(t) for d, t in rows}
    count = Counter(tuple(w[i : i + 20]) for w in texts.values() for i in range(len(w) - 19))
    covered = Counter()
    for p in got:
        w = texts[p["doc"]][p["start"] : p["start"] + p["words"]]
        assert len(w) == p["words"] >= 20
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            covered[g] += 1
            assert count[g] == p["copies"]
    assert set(covered.values()) == {1} and set(covered) == {g for g, n in count.items() if n > 1}
    # Paths can't be joined: what follows one differs between its copies, or has other copies.
    for p in got:
        w, end = texts[p["doc"]], p["start"] + p["words"]
        after = {tuple(v[i + 1 : i + 21]) for v in texts.values() for i in range(len(v) - 19) if v[i : i + 20] == w[end - 20 : end]}
        assert len(after) > 1 or len(next(iter(after))) < 20 or count[next(iter(after))] != p["copies"]


def test_window_hashes_and_anchors():
    r = random.Random(4)
    words = np.array([r.randrange(5) for _ in range(400)], np.uint64)
    a, b = op.window_hashes(words, 6)
    same = {}
    for i in range(395):
        same.setdefault(tuple(words[i : i + 6].tolist()), set()).add((int(a[i]), int(b[i])))
    assert all(len(v) == 1 for v in same.values()) and len(set().union(*same.values())) == len(same)
    h, starts = op.anchors(words, 6, 3)
    of = h[np.searchsorted(starts, np.arange(395), side="right") - 1]
    held = {}
    for i in range(395):
        held.setdefault(tuple(words[i : i + 6].tolist()), set()).add(int(of[i]))
    assert all(len(v) == 1 for v in held.values())


def test_ranges():
    a, z = op.merged(np.array([0, 2, 7, 7]), np.array([2, 5, 8, 12]))
    assert (a.tolist(), z.tolist()) == ([0, 7], [5, 12])
    a, z = op.outside(np.array([0, 10]), np.array([6, 12]), np.array([2, 4, 11, 50]), np.array([3, 6, 20, 60]))
    assert (a.tolist(), z.tolist()) == ([0, 3, 10], [2, 4, 11])


def test_query_long_text_empty_table_and_clashing_names(spark, tmp_path):
    long = " ".join(f"w{i % 150_000}" for i in range(300_000))
    rows = [(1, long), (2, " ".join(f"w{i}" for i in range(40, 90))), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op.op12_substring_dedup(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    # The windows across the seam are new: they keep no word of the second turn, all of which later windows cover.
    kept = long.split()[:150_000]
    assert got == {1: (300_000, 150_000, sha(" ".join(kept))), 2: (50, 50, sha("")), 3: (0, 0, sha(""))}
    wide = spark.createDataFrame([(5, rows[1][1], 1, 2, 3), (6, rows[1][1], 1, 2, 3)], "`k.id` int, `x.text` string, s_doc int, _repeats int, S_DOC int")
    out, name = op.dedup(wide, doc_id="k.id", text="x.text")
    assert out.columns == [*wide.columns, "__repeats"] and sorted((r[0], len(r[-1]["kept"])) for r in out.collect()) == [(5, len(rows[1][1])), (6, 0)]
    assert op.dedup(wide.limit(0), doc_id="k.id", text="x.text")[0].collect() == []


def test_no_batch_of_texts_is_large(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"
    seen.mkdir()

    def counted(make):
        def passes(*a):
            run = make(*a)

            def out(batches):
                for b in batches:
                    (seen / f"{make.__name__}-{b.num_rows}").touch()
                    yield from run(iter([b]))

            return out

        return passes

    for name in ("_sketch_pass", "_edge_pass", "_cut_pass"):
        monkeypatch.setattr(op, name, counted(getattr(op, name)))
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{text} own{i}") for i in range(1300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in op.op12_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (31, 30 if i else 0) for i in range(1300)}
    names = [p.name.rsplit("-", 1) for p in seen.iterdir()]
    assert {n for n, _ in names} == {"_sketch_pass", "_edge_pass", "_cut_pass"} and max(int(k) for _, k in names) <= 500
