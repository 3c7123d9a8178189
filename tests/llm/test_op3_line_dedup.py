import hashlib
import random
from collections import defaultdict

import numpy as np

from curatrix.llm import op3_line_dedup as op

SPACE = " \t\n\x0b\x0c\r"


def fold(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(k := fold(line)) >= 20:
                holders[k].add(-(2**63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(fold(x), ())) < 3 or max(holders[fold(x)]) == (-(2**63) if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    done = op.apply_bitmaps(df, op.keep_bitmaps(df))
    return sorted(((r["doc_id"], r["d"]["n_lines"], r["d"]["n_dropped"], hashlib.sha256(r["d"]["kept"].encode()).hexdigest()) for r in done.select("doc_id", done["_line_dedup"].alias("d")).collect()), key=str)


def test_against_brute_force(spark, docs):
    r = random.Random(1)
    pool = [f"a shared line of some length {i}" for i in range(12)] + ["short", "", "  \tÉTÉ shared line with accents  ", "x" * 19, "y" * 20]
    rows = [(i, "\n".join(r.choice(pool) + r.choice(["", "", " ", "\t"]) for _ in range(r.randrange(12)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, pool[0]), (None, pool[0]), (5, pool[1]), (5, pool[1]), (5, rows[5][1]), (300, "\n".join([pool[2]] * 500)), (301, "UPPER " + "z" * 200_000)]
    assert run(docs(rows)) == brute(rows)


def test_hot_line_over_many_ranges(spark, docs):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        hot = "the very same line in every document"
        rows = [(i, f"{hot}\nown line of document number {i}\n{hot}") for i in range(400)]
        got = run(docs(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows) and sum(n for _, _, n, _ in got) == 2 * 399


def test_runs_over_batches_of_any_size():
    r = random.Random(2)
    rows = sorted(((bytes([r.randrange(6)]) * 16, -r.randrange(8), 0, r.randrange(5)) for _ in range(300)))
    h = np.array([x[0] for x in rows], dtype="V16")
    doc, row, pos = (np.array([x[k] for x in rows]) for k in (1, 2, 3))
    doc = -doc
    results = set()
    for step in (1, 2, 7, 50, 300):
        state, out = op._Runs(3), []
        for a in range(0, 300, step):
            out += list(state.feed(h[a : a + step], doc[a : a + step], row[a : a + step], pos[a : a + step]))
        out += list(state.close(last=True))
        flat = sorted((k, int(d), int(p)) for kind, hh, ds, rs, ps, fs in out for k, d, p in zip(kind, ds, ps, strict=True) if k == op._DROP)
        results.add(tuple(flat))
    assert len(results) == 1


def test_bitmaps_and_empty_table(docs):
    packed = op.pack_bitmap(11, [0, 3, 10])
    assert op.unpack_bitmap(packed, 11).tolist() == [i not in (0, 3, 10) for i in range(11)]
    assert run(docs([]).limit(0)) == []


def test_clashing_columns_and_names_with_dots(spark):
    hot = "a line that all of these documents hold"
    rows = [(i, f"{hot}\nown {i}", i, i, i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "`k.id` int, `x.text` string, _b_doc int, _line_dedup int, doc int, c1 int")
    bm = op.keep_bitmaps(df, doc_id="k.id", text="x.text")
    done = op.apply_bitmaps(df, bm, doc_id="k.id", text="x.text")
    assert done.columns == [*df.columns, "__line_dedup"]
    got = sorted((*r[:-1], r["__line_dedup"]["kept"]) for r in done.collect())
    assert got == [(*r, r[1] if r[0] == 3 else f"own {r[0]}") for r in rows]
