import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import common
from curatrix.llm import op9_jaccard_join as op


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    key = [-(2**63) if d is None else d for d, _ in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, k in enumerate(key):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((key[i], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def run(df, **how):
    return sorted((r["doc"], r["n_shingles"], r["component_id"]) for r in op.jaccard_components(df, **how).collect())


def corpus(seed, n=160, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = " ".join(r.choice(words) for _ in range(30))
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.25:
            t = r.choice(rows)[1] or ""
        elif rows and kind < 0.65:
            t = " ".join(r.choice(words) if r.random() < r.choice([0.01, 0.03, 0.06]) else w for w in (r.choice(rows)[1] or "x").split())
        else:
            t = " ".join(r.choice(words) for _ in range(r.randrange(1, 120)))
            t = f"{t} {passage}" if r.random() < 0.4 else t
        rows.append((i, t.upper() if r.random() < 0.1 else t))
    return rows


def test_against_brute_force(spark, docs):
    for seed in (1, 2):
        rows = [*corpus(seed), (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "one two three"), (906, "É É É É É É")]
        assert run(docs(rows)) == brute(rows)


def test_near_copies_of_one_text_in_small_blocks(spark, docs):
    r = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        t = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            t[r.randrange(150)] = f"e{i}x{r.randrange(9)}"
        rows.append((i, " ".join(t)))
    want = brute(rows)
    assert run(docs(rows)) == want and run(docs(rows), block_docs=16) == want


def test_blocks_bounded_by_tokens(spark, docs, monkeypatch):
    rows = corpus(11, n=120, vocabulary=150)
    monkeypatch.setattr(op, "BLOCK_TOKENS", 50)
    assert run(docs(rows)) == brute(rows)


def test_chain_and_threshold(spark, docs):
    w = [f"x{i}" for i in range(60)]
    chain = [(i, " ".join(w[i * 3 : i * 3 + 40])) for i in range(6)]
    seven = [(50, " ".join(f"y{i}" for i in range(11))), (51, " ".join(f"y{i}" for i in range(10)) + " z"), (52, " ".join([*(f"q{i}" for i in range(13)), "r1"])), (53, " ".join([*(f"q{i}" for i in range(13)), "r2"]))]
    rows = chain + seven
    assert run(docs(rows)) == brute(rows)


def test_shared_ids_nulls_repeats(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (9, a), (9, a), (None, b + " tail"), (7, b), (8, None)]
    assert run(docs(rows)) == brute(rows)
    assert run(docs(rows).limit(0)) == []
    kept = op.keep_one(docs([(4, a), (2, a + " x"), (3, None), (6, b)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 6] and kept.columns == ["doc_id", "text", "pieces"]
    kept = op.keep_one(docs([(4, a), (4, a), (4, b), (None, None), (None, None), (3, None), (6, b)]))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(4, a), (4, b), (0, ""), (3, "")])


def test_clashing_columns_and_names_with_dots(spark):
    a = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(4, a, 1, 2, 3), (2, a, 4, 5, 6), (3, None, 7, 8, 9)], "`k.id` int, `x.text` string, _gone int, key int, doc int")
    kept = op.keep_one(df, doc_id="k.id", text="x.text")
    assert kept.columns == df.columns and sorted(tuple(r)[2:] for r in kept.collect()) == [(4, 5, 6), (7, 8, 9)]


def test_shared_counts_in_slices(monkeypatch):
    r = np.random.default_rng(5)
    doc, token = (x[:, 0] for x in np.split(np.unique(np.stack([r.integers(0, 40, 900), r.integers(0, 200, 900)], 1), axis=0), 2, axis=1))
    sets = [set(token[doc == d].tolist()) for d in range(40)]
    left, right = np.arange(0, 25), np.arange(10, 40)
    for cells in (1, 60, 700, 1 << 22):
        monkeypatch.setattr(op, "SLICE_CELLS", cells)
        assert op.shared_counts(doc, token, left, right).tolist() == [[len(sets[i] & sets[j]) for j in right] for i in left]


def test_hubs_over_batches():
    import pyarrow as pa

    rows = [(1, 5), (1, 6), (2, 7), (3, 1), (3, 2), (3, 9), (4, 4)]
    want = {(5, 1, 5), (5, 1, 6), (1, 3, 1), (1, 3, 2), (1, 3, 9)}
    for step in (1, 2, 3, 7):
        batches = [pa.record_batch({"token": [t for t, _ in rows[a : a + step]], "doc": [d for _, d in rows[a : a + step]]}) for a in range(0, 7, step)]
        assert {tuple(x.values()) for b in op._hubs(batches) for x in b.to_pylist()} == want


def test_prefixes_share_what_the_theorem_says():
    r = random.Random(3)
    counts = np.random.default_rng(0).integers(1, 500, 1 << op.SKETCH_BITS)
    for _ in range(200):
        a = np.unique(common.mix64(np.array([r.randrange(90) for _ in range(80)], np.uint64)))
        b = np.unique(np.concatenate((r.sample(a.tolist(), int(len(a) * 0.9)), common.mix64(np.array([r.randrange(1000) for _ in range(4)], np.uint64)))).astype(np.uint64))
        shared = len(np.intersect1d(a, b))
        if op.links(len(a), len(b), shared):
            (pa_, la, *_), (pb, lb, *_) = op.prefix_of(a, counts, 100.0), op.prefix_of(b, counts, 100.0)
            assert len(np.intersect1d(pa_, pb)) >= min(la, lb)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_word_hashes_split_as_the_pattern(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    h = common.word_hashes(t.encode().lower(), common.SPACE_BYTES)
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))


def test_long_texts_hash_in_pieces():
    word = b"abc"
    text = (word + b" ") * 400_000 + b"z" * 2_000_000
    h = common.word_hashes(text, common.SPACE_BYTES)
    assert len(h) == 400_001 and len(set(h.tolist())) == 2
