import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import op1_sentencepiece as op

V = op.load_vocabulary(op.default_model())


def encode(texts, keys=None, seed=op.SEED):
    keys = np.arange(len(texts), dtype=np.int64) if keys is None else np.array(keys, np.int64)
    ids, n = op.encode_batch(texts, keys, V, seed)
    cut = np.cumsum(n)[:-1]
    return [x.tolist() for x in np.split(ids, cut)]


def paths(s):
    if not s:
        yield ()
    for k in range(1, len(s) + 1):
        if s[:k] in V.pieces:
            for rest in paths(s[k:]):
                yield (V.pieces[s[:k]], *rest)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=4))
def test_round_trip_of_any_text(texts):
    assert [op.decode_ids(x, V) if x else "" for x in encode(texts)] == texts


def test_awkward_texts():
    texts = ["", " ", "   ", "▁", "a ▁ b", "\n\n", "x\x00y", "漢字😀", "a" * 3000, "ab" * 40 + " " * 50 + "c", "▁▁ "]
    got = encode(texts)
    assert got[0] == [] and [op.decode_ids(x, V) if x else "" for x in got] == texts


def test_draws_follow_the_product_of_weights():
    weights = {p: math.exp(sum(V.logp[i] for i in p)) for p in paths(" xolo")}
    total = sum(weights.values())
    n = 30000
    seen = Counter(map(tuple, encode(["xolo"] * n)))
    assert set(seen) <= set(weights)
    for p, w in weights.items():
        expect = n * w / total
        assert abs(seen[p] - expect) < 6 * math.sqrt(expect + 1)


def test_same_key_same_pieces_whatever_the_batch():
    words = ["internationalization of tokenizers", "xolotl quetzal", "zzz"]
    together, alone = encode(words, [7, 8, 9]), [encode([w], [k])[0] for w, k in zip(words, (7, 8, 9), strict=True)]
    assert together == alone
    assert len({tuple(encode(["xoloxoloxolo"], [k])[0]) for k in range(300)}) > 1
    assert encode(words, [7, 8, 9], 1) == encode(words, [7, 8, 9], 1)


def test_frame(spark, docs):
    df = docs([(1, "the cat"), (None, None), (2, ""), (1, "the cat")])
    out = op.decode(op.encode(df, op.default_model()), op.default_model(), column="_pieces")
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "pieces", "_pieces", "decoded"]
    assert all(r["decoded"] == r["text"] for r in rows)
    assert next(r["_pieces"] for r in rows if r["text"] is None) is None and next(r["_pieces"] for r in rows if r["text"] == "") == []
    assert len({tuple(r["_pieces"]) for r in rows if r["text"] == "the cat"}) == 1
    assert op.encode(df.limit(0), op.default_model()).count() == 0


def test_query(spark):
    rows = op.op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r["lossless"] and r["n_pieces"] == len(r["pieces"]) for r in rows)


def test_parts_of_a_long_text_give_what_the_whole_gives(monkeypatch):
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("abcxolo the  \n▁é漢😀")) for _ in range(n)) for n in (0, 1, 50, 700, 3000)] + ["xolotl" * 300 + " end", "    " * 100 + "x\n\n  y" * 40]
    want = encode(texts, range(len(texts)))
    for most, long, block in ((1, 10_000, 64), (37, 40, 16), (5, 1, 16), (100, 20, 33)):
        monkeypatch.setattr(op, "CHUNK_CHARS", most)
        monkeypatch.setattr(op, "LONG_CHARS", long)
        monkeypatch.setattr(op, "BLOCK", block)
        monkeypatch.setattr(op.parts, "__defaults__", (most, long))
        for t in texts[1:]:
            cut = list(op.parts(" " + t))
            assert "".join(p for _, p in cut) == " " + t and all((" " + t).startswith(p, a) for a, p in cut)
        assert encode(texts, range(len(texts))) == want


def test_a_run_without_spaces_is_sampled_by_blocks():
    text = "internationalisation" * 20_000  # 400,000 characters, four times a long segment
    [ids] = encode([text])
    assert op.decode_ids(ids, V) == text
    assert encode([text, "x"], [0, 1])[0] == ids


def test_clashing_columns_and_names_with_dots(spark):
    df = spark.createDataFrame([(1, "the cat", 7, 8)], "`k.id` int, `x.text` string, _key int, pieces int")
    out = op.encode(df, op.default_model(), key="k.id", text="x.text")
    back = op.decode(out.withColumnRenamed("pieces", "decoded"), op.default_model(), column="_pieces")
    r = back.first()
    assert back.columns == ["k.id", "x.text", "_key", "decoded", "_pieces", "_decoded"] and r["_decoded"] == "the cat" and tuple(r)[:4] == (1, "the cat", 7, 8)
