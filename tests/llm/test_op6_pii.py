import hashlib
import random
import re
import time

import numpy as np
import pytest

from curatrix.llm import op6_pii_crf as op


@pytest.fixture(scope="module")
def crf():
    return op.default_model()


def test_base_spans():
    cases = {
        "write to a.b+c@x-1.example.com. now": [(9, 30, "email")],
        "a@b@c.de x@y": [(2, 8, "email")],
        "at 10.0.0.255 or 256.1.1.1 or 1.2.3.4.5": [(3, 13, "ip"), (30, 37, "ip")],
        "4111 1111 1111 1111 and 4111111111111112": [(0, 19, "card")],
        "call +1 (407) 555-7710 or +12 34": [(5, 22, "phone")],
        "é 10.0.0.1": [(2, 10, "ip")],
        "": [],
    }
    for text, want in cases.items():
        assert op.base_spans(text) == want, text


def test_greedy_match_that_fails_is_dropped_whole():
    assert op.base_spans("4111 1111 1111 1111 7") == []
    assert op.base_spans("x 99999999999999999999 y") == []


def test_luhn():
    assert op.luhn("4111111111111111") and not op.luhn("4111111111111112")


def test_viterbi_against_all_paths(crf):
    import itertools

    sent = ["mail", "x1", "at", "y.com"]
    rows = crf.rows(sent)
    e = np.array([crf.weights[r].sum(0) if r else np.zeros(op.K) for r in rows])
    best = max(itertools.product(range(op.K), repeat=4), key=lambda p: crf.first[p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert tuple(crf.decode([sent, ["one"]])[0]) == best


def test_held_out_accuracy(crf):
    rows = op.labelled_table(300, 99)
    got = crf.decode([t for t, _ in rows])
    right = sum(op.LABELS[p] == x for g, (_, labels) in zip(got, rows, strict=True) for p, x in zip(g, labels, strict=True))
    assert right / sum(len(x) for _, x in rows) > 0.97


def test_added_spans(crf):
    texts = ["mail john at example dot com now", "call (407) 555-7710 today", "card 4111/1111/1111/1111", "in 2024 there were 12,000 items at 3.5 v1.2.3", "+1 (407) 555-7710", "plain words only\nno sign at all"]
    base = [op.base_spans(t) for t in texts]
    added = op.added_spans(crf, texts, base, {})
    found = [[(t[a:z], k) for a, z, k in x] for t, x in zip(texts, added, strict=True)]
    assert found == [[("john at example dot com", "email")], [("(407) 555-7710", "phone")], [("4111/1111/1111/1111", "card")], [], [], []]


def test_frame(spark, docs):
    df = docs([(1, "a@b.co 10.0.0.1"), (2, None), (3, ""), (1, "a@b.co 10.0.0.1"), (4, "word " * 20000 + "z@z.zz")]).withColumnRenamed("pieces", "spans")
    rows = op.find_pii(df).collect()
    by = {r["doc_id"]: r["_pii"] for r in rows}
    assert by[1]["base"] == by[1]["spans"] == "email:0:6,ip:7:15" and by[1]["n_email"] == 1 and by[1]["n_phone"] == 0
    assert by[2]["spans"] == by[3]["spans"] == "" and by[4]["spans"] == "email:100000:100006"
    assert op.find_pii(df.limit(0)).count() == 0
    assert op.redact_text("x a@b.co y", "email:2:8") == "x [EMAIL] y"


def test_query_digest(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in op.op6_pii_crf(spark, sf).collect():
        base = op.base_spans(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{z}" for a, z, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["n_ip"] == sum(k == "ip" for *_, k in base)
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
        assert all(re.fullmatch(r"(email|ip|card|phone):\d+:\d+", s) for s in filter(None, r["spans"].split(",")))


def plain_spans(text):
    """The patterns of the contract as they are written."""
    out = []
    for kind, pattern in op.PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and op.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], op.KINDS.index(s[2]), s[1]))


def test_base_spans_against_the_written_patterns():
    r = random.Random(7)
    parts = ["a", "Zq", "@", "@", ".", ".", "-", "+", "1", "25", "256", "007", " ", "(", ")", "_", "%", "4111 1111 1111 1111", "4111111111111111", "+1 (407) 555-7710", "10.0.0.1", "a.b@c-d.org", "\n", "é", ","]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        assert op.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time(crf):
    n = 1_000_000
    texts = ["1" * n, "a" * n + " b@c.de", "a" * n + "@", "1." * (n // 2), "@" * n, "+1(" * (n // 3), "a@" * (n // 2), "1 " * (n // 2), "a." * (n // 2) + "@" + "b." * 1000]
    began = time.time()
    base = [op.base_spans(t) for t in texts]
    got = op.added_spans(crf, texts, base, {})
    assert base[1] == [(n + 1, n + 7, "email")] and len(got) == len(texts)
    assert time.time() - began < 90


def test_pieces_of_a_line_give_what_the_whole_line_gives(crf, monkeypatch):
    r = np.random.default_rng(8)
    rows = op.labelled_table(60, 77)
    text = " ".join(t for tokens, _ in rows for t in tokens)
    whole = op.added_spans(crf, [text], [[]], {})
    for size, context in ((16, 8), (50, 20), (1000, 32)):
        monkeypatch.setattr(op, "PIECE", size)
        monkeypatch.setattr(op, "CONTEXT", context)
        monkeypatch.setattr(op, "BATCH_TOKENS", int(r.integers(1, 400)))
        tokens = [(t, s) for p in op.line_pieces(text, 0, len(text)) for t, s in list(zip(p[0], p[1], strict=True))[p[2] : p[3]]]
        assert tokens == [(m[0], m.start()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text)]
        assert op.added_spans(crf, [text], [[]], {}) == whole


def test_stretches_free_of_spans():
    spans = [(5, 9, "ip"), (7, 12, "card"), (20, 21, "ip"), (12, 14, "phone")]
    free = op.free_of(spans)
    for a in range(25):
        for z in range(a + 1, 26):
            assert free(a, z) == (not any(a < e and s < z for s, e, _ in spans))


def test_clashing_columns_and_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a@b.co", 7, 8)], "`k.id` int, `x.text` string, _pii int, c1 int")
    out = op.find_pii(df, text="x.text")
    r = out.first()
    assert out.columns == [*df.columns, "__pii"] and tuple(r)[:4] == (1, "a@b.co", 7, 8) and r["__pii"]["n_email"] == 1
