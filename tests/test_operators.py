"""Operators against hand-computed cases and brute force in plain Python."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import assemble, compare, contracts, near_dup, prep, profile, score, select, splits
from curatrix.operators.components import connected_components

GOOD = {
    "blueprint_version": "1.0", "name": "my-skill", "description": "does a thing", "purpose": "p", "when_to_use": ["x"], "when_not_to_use": [],
    "files": [{"path": "SKILL.md", "purpose": "m", "content": "---\nname: my-skill\ndescription: d\n---\nhi"}, {"path": "scripts/a.py", "purpose": "s", "content": "c"}],
}


def variant(**changes):
    out = json.loads(json.dumps(GOOD))
    for k, v in changes.items():
        if v is ...:
            del out[k]
        else:
            out[k] = v
    return json.dumps(out)


def scored(spark, outputs, refs=None):
    preds = spark.createDataFrame([(str(i), o) for i, o in enumerate(outputs)], "id string, output string")
    rows = refs if refs is not None else [(str(i), json.dumps(GOOD), i) for i in range(len(outputs))]
    return score.score_items(preds, spark.createDataFrame(rows, "id string, ref string, _pos bigint"))


def test_schema_errors(spark):
    f = lambda **x: {"path": "SKILL.md", "purpose": "m", "content": "c"} | x
    cases = [
        (json.dumps(GOOD), []),
        ("[]", ["blueprint is not an object"]),
        (variant(name=...), ["missing field: name", "invalid name: ''"]),
        (variant(name=None), ["field name has wrong type"]),
        (variant(name=1), ["field name has wrong type"]),
        (variant(name="Bad_Name!"), ["invalid name: 'Bad_Name!'"]),
        (variant(description=""), ["empty description"]),
        (variant(description=...), ["missing field: description", "empty description"]),
        (variant(description=0), ["field description has wrong type", "empty description"]),
        (variant(description=[]), ["field description has wrong type", "empty description"]),
        (variant(files=[]), ["files is empty", "files missing SKILL.md"]),
        (variant(files="x"), ["field files has wrong type"]),
        (variant(files=[f(), 3]), ["files[1] not an object"]),
        (variant(files=[f(), f(path="/x", content="")]), ["files[1].content missing/empty", "files[1].path unsafe: '/x'"]),
        (variant(files=[f(path="docs/SKILL.md")]), ["files missing SKILL.md"]),
        (variant(when_to_use=["a", 1]), ["when_to_use must be list[str]"]),
        (variant(when_to_use="a"), ["field when_to_use has wrong type"]),
    ]
    rows = {r["id"]: r for r in scored(spark, [c for c, _ in cases]).collect()}
    for i, (_, want) in enumerate(cases):
        assert rows[str(i)]["l2_errors"] == want, cases[i]
        assert rows[str(i)]["l2_valid"] == (not want)


def test_layers(spark):
    outs = [json.dumps(GOOD), "not json", "```json\n" + json.dumps(GOOD) + "\n```", variant(name="other", files=GOOD["files"][:1]), variant(files=GOOD["files"][1:]), variant(files=[GOOD["files"][0], {"path": "a", "purpose": "x", "content": "y"}, {"path": "a/b", "purpose": "x", "content": "y"}])]
    r = {x["id"]: x for x in scored(spark, outs).collect()}
    assert r["0"]["l5_materialize"] and r["0"]["name_em"] == 1.0 and r["0"]["file_path_f1"] == 1.0 and r["0"]["desc_token_f1"] == 1.0
    assert r["1"]["l1_parse"] is False and r["1"]["l2_valid"] is None
    assert r["2"]["l1_parse"] and r["2"]["l2_valid"]
    assert r["3"]["name_em"] == 0.0 and 0 < r["3"]["file_path_f1"] < 1
    assert r["4"]["l5_errors"] == ["SKILL.md not materialized"]
    assert r["5"]["l5_errors"] == ["materialize error"]


def brute_files(files):
    """Why files can't be laid out, by laying them out."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as d:
        try:
            for f in files:
                p = Path(d) / f["path"]
                if ".." in f["path"] or f["path"].startswith("/"):
                    return [f"unsafe path: {f['path']}"]
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_text(f.get("content", ""))
            if not (Path(d) / "SKILL.md").exists():
                return ["SKILL.md not materialized"]
            head = re.match(r"---\s*\n(.*?)\n---\s*\n", (Path(d) / "SKILL.md").read_text(), re.DOTALL)
            if not head:
                return ["SKILL.md frontmatter missing"]
            return [f"frontmatter missing {k}:" for k in ("name", "description") if not re.search(rf"^{k}:\s*\S", head[1], re.M)]
        except (OSError, KeyError, TypeError, ValueError):
            return ["materialize error"]


def test_files_and_fields_of_any_type(spark):
    main = {"path": "SKILL.md", "purpose": "m", "content": "---\nname: x\ndescription: y\n---\nb"}
    f = lambda path, **x: {"path": path, "purpose": "p", "content": "c"} | x
    lists = [
        [main], [], [{}], [main, {}], [main, {"path": "a"}], [main, f(None)], [main, f(3)], [main, f("")], [main, f(".")], [main, f("a", content=None)], [main, f("a", content=1)], [3, f("/x")], [f("/x"), {}], [{}, f("/x")],
        [main, f("a"), f("a/b")], [main, f("a/b"), f("a")], [main, f("a"), f("../a"), f("a/b")], [f("./SKILL.md", content=main["content"])], [f("SKILL.md/x")], [main, f("SKILL.md", content="none")], [f("SKILL.md", content="old"), main],
        [f("SKILL.md", content=main["content"].replace("\n", "\r\n"))], [f("SKILL.md", content="---\nname:\ndescription: y\n---\n")], [f("SKILL.md", content="---\nother: 1\n---\n")], [main, f("x" * 300)], [main, f("a\x00b")], [main, f("a//b"), f("a/./b")],
    ]
    outs = [json.dumps({"files": x}) for x in lists]
    rows = {int(r["id"]): r for r in scored(spark, outs).collect()}
    for i, x in enumerate(lists):
        assert rows[i]["l5_errors"] == brute_files(x), x
    pairs = [({"name": 1}, {}), ({"name": None}, {}), ({"name": 1}, {"name": 1.0}), ({"name": True}, {"name": 1}), ({"name": "1"}, {"name": 1}), ({"name": {"b": 1, "a": 2}}, {"name": {"a": 2, "b": 1}}), ({"files": [{}]}, {"files": []}), ({"files": [{}]}, {"files": [{"path": None}]}), ({"files": [{"path": 1}, {"path": "1"}]}, {"files": [{"path": "1"}]})]
    refs = [(str(i), json.dumps(b), 0) for i, (_, b) in enumerate(pairs)]
    got = {int(r["id"]): (r["name_em"], round(r["file_path_f1"], 6)) for r in scored(spark, [json.dumps(a) for a, _ in pairs], refs).collect()}
    key = lambda v: {x.get("path") for x in v.get("files", [])}
    for i, (a, b) in enumerate(pairs):
        x, y = key(a), key(b)
        both = len(x & y)
        f1 = 1.0 if not x and not y else 0.0 if not both else 2 * both / (len(x) + len(y))
        assert got[i] == (float(a.get("name") == b.get("name")), round(f1, 6)), (a, b)


def test_what_only_the_exact_reader_takes(spark):
    outs = ['{"name": NaN}', '{"name": "a", "name": "b"}', "{'a': 1}", '{"a": Infinity, "b": [-Infinity]}', '{"a": 1} x']
    preds = spark.createDataFrame([(str(i), o) for i, o in enumerate(outs)], "id string, output string")
    refs = spark.createDataFrame([(str(i), '{"name": "b"}', 0) for i in range(len(outs))], "id string, ref string, _pos bigint")
    exact, plain = ({r["id"]: r for r in score.score_items(preds, refs, exact=x).collect()} for x in (True, False))
    assert [exact[str(i)]["l1_parse"] for i in range(5)] == [True, True, False, True, False] and exact["1"]["name_em"] == 1.0
    assert not any(plain[str(i)]["l1_parse"] for i in range(5)) and "field name has wrong type" in exact["0"]["l2_errors"]


def test_quoted_as_python_does(spark):
    from curatrix.functions.text import quoted

    texts = ["", "plain", "it's", 'say "x"', "it's \"x\"", "a\nb\tc\r", "back\\slash", "\x00\x1f\x7f\x85\xa0\xad", "é漢"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", quoted(F.col("t")).alias("q")).collect()
    assert [r["q"] for r in sorted(got)] == [repr(t) for t in texts]


def test_missing_and_repeated_references(spark):
    items = scored(spark, [json.dumps(GOOD), json.dumps(GOOD)], [("0", variant(name="old"), 0), ("0", json.dumps(GOOD), 1)])
    r = {x["id"]: x for x in items.collect()}
    assert r["0"]["name_em"] == 1.0 and not r["1"]["has_ref"] and r["1"]["l1_parse"] is None
    s = score.summary(items).first()
    assert s["n"] == 2 and s["l1"] == 0.5 and s["l3"] == 1.0
    codes = {x["id"]: x["codes"] for x in score.item_codes(items).collect()}
    assert codes == {"0": [], "1": ["E10"]}


def test_score_of_perfect_and_garbage(spark):
    assert abs(score.summary(scored(spark, [json.dumps(GOOD)] * 3)).first()["score"] - 1.0) < 1e-12
    assert score.summary(scored(spark, ["x"] * 3)).first()["score"] == 0.0


def test_taxonomy_counts_every_code(spark):
    items = scored(spark, [variant(purpose=..., name="A b")] * 5)
    got = {r["code"]: r["n_items"] for r in score.taxonomy(items).collect()}
    assert got == {f"E{i}": 5 if i in (2, 4) else 0 for i in range(1, 11)}


def run(spark, outcomes):
    return spark.createDataFrame([(str(i), i, o) for i, o in enumerate(outcomes)], "id string, _pos bigint, l2_valid boolean")


def test_repair_loop_asks_again_for_what_failed_alone(spark):
    from curatrix.plans.score_queries import loop_model

    df = spark.createDataFrame([(i, f"Make {i}: text {i}") for i in range(44)] + [(3, "Make 3: again")], "id bigint, request string")
    log = assemble.repair_loop(df, loop_model, score.blueprint_errors).collect()
    need = {i: i % 4 + 1 for i in range(44)}
    boom = {i for i in need if i % 11 == 3 and need[i] > 1}
    assert Counter(r["attempt"] for r in log) == {1: 45, 2: sum(n > 1 for n in need.values()) + 1, 3: sum(n > 2 and i not in boom for i, n in need.items())}
    status = {r["id"]: r for r in assemble.loop_status(assemble.repair_loop(df.where("id <> 3"), loop_model, score.blueprint_errors)).collect()}
    assert {i: r["status"] for i, r in status.items()} == {i: 502 if i in boom else 200 if n < 4 else 422 for i, n in need.items() if i != 3}
    assert status[14]["failure"] == "RuntimeError: out of memory" and status[14]["n_attempts"] == 2 and status[7]["errors"] == ["invalid name: 'Doc-7'", "files is empty", "files missing SKILL.md"]
    second = next(r for r in log if r["id"] == 5 and r["attempt"] == 2)
    assert second["prompt"].startswith("Make 5: text 5\n\nYour previous output was rejected") and "- L1 parse failure" in second["prompt"]
    assert assemble.repair_loop(df.limit(0), loop_model, score.blueprint_errors).isEmpty()


def test_deal_with_a_split_of_no_size(spark):
    df = spark.createDataFrame([(i, i, "d") for i in range(20)], "id bigint, c bigint, dom string")
    got = Counter(r["split"] for r in splits.deal_simple(df, {"train": 2, "val": 0, "test": 1}, domain="dom", key="id").collect())
    assert got == {"train": 14, "test": 6}
    with pytest.raises(ValueError, match="a deal takes"):
        splits.deal_simple(df, {"train": 0}, domain="dom", key="id")


def test_paired_runs(spark):
    p = compare.paired(run(spark, [True, True, False, None]), run(spark, [True, False, True, False]), "l2_valid")
    assert tuple(compare.paired_counts(p).first()) == (1, 1, 1, 1, 4)
    assert [r[0] for r in compare.regressions(p).collect()] == ["1"] and [r[0] for r in compare.new_passes(p).collect()] == ["2"]
    assert compare.new_failures(p, spark.createDataFrame([("1",)], "id string")).isEmpty()
    out = compare.compare_runs(run(spark, [True] * 8), run(spark, [True] * 8), "l2_valid").first()
    assert out["diff"] == 0 and out["p_value"] == 1.0
    empty = compare.compare_runs(run(spark, []), run(spark, []), "l2_valid").first()
    assert empty["n"] == 0 and empty["rate_a"] is None and empty["diff_lo"] is None
    with pytest.raises(Exception, match="different items"):
        compare.paired(run(spark, [True]), run(spark, [True, False]), "l2_valid").collect()


def words(text):
    return set(re.findall("[a-z0-9]+", text.lower()))


def brute_pairs(rows):
    sets = [(i, words(t)) for i, t in rows]
    return {(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if a and b and 5 * len(a & b) > 4 * max(len(a), len(b))}


def test_repair_loop_writes_a_request_once_a_round(spark, monkeypatch):
    from curatrix.plans.score_queries import loop_model

    written, real = [], assemble.staged
    monkeypatch.setattr(assemble, "staged", lambda df, name: (written.append(df.columns), real(df, name))[1])
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return loop_model(prompts)

    df = spark.createDataFrame([(i, f"Make {i}: text {i}") for i in range(40) if i % 11 != 3], "id bigint, request string")
    log = assemble.repair_loop(df, model, score.blueprint_errors)
    assert len(written) == 3 and all("_request" in c and "prompt" not in c for c in written)
    assert asked.value == log.count()


def test_repair_loop_parses_an_output_once(spark):
    df = spark.createDataFrame([(1, json.dumps(GOOD)), (2, "no"), (3, None), (4, "[]"), (5, "```json\n" + variant(name="A b", files=[]) + "\n```"), (6, '{"name":"a","name":NaN}')], "id bigint, output string")
    checked = df.withColumn("errors", score.blueprint_errors(F.col("output")))
    # Whether it parses, its value, and the same again of what Python is asked for; each check of the schema parsed it again.
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 10
    got = {r["id"]: r["errors"] for r in checked.collect()}
    failed = ["L1 parse failure: output is not valid JSON"]
    assert got[1] == [] and got[2] == got[3] == failed and got[4] == ["blueprint is not an object"]
    assert got[5] == ["invalid name: 'A b'", "files is empty", "files missing SKILL.md"]
    assert got[6][0] == "missing field: blueprint_version" and "field name has wrong type" in got[6]


def test_only_what_begins_as_json_goes_to_python(spark):
    from curatrix.functions import jsonx, text

    takes = ['{"a":NaN}', ' \n[1,{"b":1,"b":2}]', "NaN", "-Infinity", "Infinity", "null", "true", "false", "-1", "0", '"x"', "```json\n{\"a\":NaN}\n```", "\u00a0{}\u2003"]
    refuses = ["Here it is: {}", "nothing", "#try", "", " ", "trust", "+1", ".5", "{} {}", "\ufeff{}", "```\nno\n```", None]
    rows = [(x, True) for x in takes] + [(x, False) for x in refuses]
    df = spark.createDataFrame(rows, "x string, good boolean").withColumn("stripped", text.strip_fences(F.col("x")))
    got = df.withColumn("got", jsonx.exactly_parsed(F.col("stripped"))).collect()
    assert [(r["x"], r["got"]) for r in got] == rows
    for r in got:
        try:
            json.loads(r["stripped"] or "")
            assert r["good"], r["x"]
        except ValueError:
            assert not r["good"], r["x"]


def test_tokens_of_a_few_texts_at_a_time():
    import pyarrow as pa

    alive = [0, 0]

    class Token(str):
        def __new__(cls, x):
            alive[0] += 1
            alive[1] = max(alive)
            return super().__new__(cls, x)

        def __del__(self):
            alive[0] -= 1

    texts = pa.array([None, "", *["a b c d e"] * 5000])
    got = prep.token_lists(texts, lambda t: [Token(x) for x in t.split()])
    assert got.to_pylist() == [None, [], *[["a", "b", "c", "d", "e"]] * 5000] and alive[1] <= 5 * prep.TOKEN_ROWS + 10
    assert prep.token_lists(texts.slice(0, 0), str.split).to_pylist() == []


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(3)
    rows = [(0, "a b c d e"), (1, "a b c d f"), (2, "a b c d e f"), (3, ""), (4, "漢字"), (5, "漢字"), (6, "a b c d e")]
    for i in range(7, 120):
        base = r.choice(rows)[1].split() or ["x"]
        new = [w if r.random() > 0.07 else f"w{r.randrange(40)}" for w in base] + [f"w{r.randrange(40)}" for _ in range(r.randrange(3))]
        rows.append((i, " ".join(new) if r.random() > 0.3 else " ".join(f"w{r.randrange(40)}" for _ in range(12))))
    df = spark.createDataFrame(rows, "id bigint, text string")
    want = brute_pairs(rows)
    assert {tuple(x) for x in near_dup.near_dup_pairs(df, "id", "text").collect()} == want
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(tuple(x) for x in near_dup.near_dup_clusters(df, "id", "text").collect()) == label


def test_clusters_of_a_large_family_without_all_pairs(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if r.random() > 0.04 else f"x{r.randrange(10**6)}" for w in base)) for i in range(1500)]
    rows += [(2000 + i, " ".join(f"y{i}z{k}" for k in range(10))) for i in range(50)]
    counted = []
    real = near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, classes: (counted.append(pairs.count()), real(pairs, classes))[1])
    got = dict(tuple(x) for x in near_dup.near_dup_clusters(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect())
    want = brute_pairs(rows)
    label = {i: i for i, _ in rows}
    while True:
        old = dict(label)
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    assert got == label and len(want) > 500_000 and sum(counted) < 30 * 1500


def test_pairs_are_counted_in_blocks_before_sets_move(spark, monkeypatch):
    r = random.Random(5)
    common = [f"c{i}" for i in range(600)]
    rows = [(i, " ".join(r.sample(common, r.randrange(20, 70)))) for i in range(300)]
    rows += [(1000 + i, t + " more") for i, t in rows[:40]]
    df = spark.createDataFrame(rows, "id bigint, text string")
    want, counted = brute_pairs(rows), []
    real = near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, classes: (counted.append(pairs.count()), real(pairs, classes))[1])
    monkeypatch.setattr(near_dup, "COUNT_CELLS", 1000, raising=False)
    for sets, tokens in ((1 << 14, 1 << 21), (40, 1500)):
        monkeypatch.setattr(near_dup, "BLOCK_SETS", sets, raising=False)
        monkeypatch.setattr(near_dup, "BLOCK_TOKENS", tokens, raising=False)
        counted.clear()
        assert {tuple(x) for x in near_dup.near_dup_pairs(df, "id", "text").collect()} == want
        # Nearly every two of these texts share a rare word; few share as many as a match must.
        assert len(want) <= sum(counted) < 1000 and len(want) >= 40


def test_blocks_of_sets_meet_without_a_shuffle(spark, monkeypatch):
    r = random.Random(6)
    common = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(r.sample(common, r.randrange(20, 40)))) for i in range(120)]
    rows += [(1000 + i, t + " more") for i, t in rows[:30]]
    members, classes = near_dup.token_classes(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    prefix = near_dup.staged(near_dup.prefixes(classes, near_dup.token_counts(classes)), "token-prefixes")
    key = {x["class"]: x["id"] for x in members.collect()}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, real = [], near_dup.write_staged
    monkeypatch.setattr(near_dup, "write_staged", lambda df, name, **o: (plans.append(plan(df)), real(df, name, **o))[1])
    met = {}
    for sets in (1 << 17, 10):
        monkeypatch.setattr(near_dup, "BLOCK_SETS", sets)
        out = near_dup.pairs_across(prefix)
        plans.append(plan(out))
        found = [tuple(sorted((key[a], key[b]))) for a, b in out.collect()]
        met[sets] = set(found)
        assert len(found) == len(met[sets])  # no pair is found twice
    # Sets were dealt to every pair of blocks before, which grows with the square of the input.
    assert not any("Exchange" in p for p in plans) and len(plans) > 10
    assert met[1 << 17] == met[10] >= brute_pairs(rows)


def test_keys_that_repeat_or_are_null(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "c b a"), (None, "a b c"), (None, "q r"), (3, "q r"), (4, ""), (5, "m n"), (6, "m n"), (6, "u v"), (7, "v u"), (8, None), (2, "k l"), (9, "l k")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    assert sorted(map(str, (tuple(x) for x in near_dup.near_dup_clusters(df, "id", "text").collect()))) == sorted(map(str, [(1, 1), (1, 1), (2, 1), (None, None), (None, None), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5), (7, 5), (8, 8), (2, 1), (9, 1)]))
    assert sorted(tuple(x) for x in near_dup.near_dup_pairs(df, "id", "text").collect()) == [(1, 2), (2, 9), (5, 6), (6, 7)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (7, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and 500 not in got
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def test_sequence_ratio_pairs(spark):
    import difflib

    texts = ["the quick brown fox", "the quick brown fix", "entirely different words here", "the quick brown fox jumps", "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and difflib.SequenceMatcher(None, a, b).ratio() > 0.8}
    assert {(r["a"], r["b"]) for r in near_dup.sequence_near_dups(df, "id", "t").collect()} == want


def test_metric_index_of_letter_counts_loses_no_pair(spark):
    import difflib

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(x) for x in d.collect()]
    facts = near_dup.letter_facts(d, "doc_id", "text")
    met = {(x["id"], x["id2"]) for x in near_dup.letter_candidates(facts, 0.8).select("id", "id2").collect()}
    # A ratio of over 0.8 takes common letters, so only such pairs are tried by brute force.
    close = lambda x, y: 2 * sum((Counter(x) & Counter(y)).values()) > 0.8 * (len(x) + len(y))
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and close(x, y) and difflib.SequenceMatcher(None, x, y).ratio() > 0.8}
    assert want <= met and len(met) < len(rows) ** 2 / 8
    assert {(x["a"], x["b"]) for x in near_dup.sequence_near_dups(d, "doc_id", "text").collect()} == want
    assert near_dup.sequence_near_dups(d.limit(0), "doc_id", "text").isEmpty()
    other = spark.createDataFrame([(i, "абвг дежз " * 20 + str(i)) for i in range(30)] + [(100 + i, "some words " * 20 + str(i)) for i in range(30)], "id int, t string")
    pairs = near_dup.letter_candidates(near_dup.letter_facts(other, "id", "t"), 0.8).select("id", "id2").collect()
    assert len(pairs) == 30 * 29 and all((x["id"] < 100) == (x["id2"] < 100) for x in pairs)


def test_sequence_ratio_of_long_texts(spark):
    import difflib

    from curatrix.plans import registry

    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    start = " ".join(r.choice(vocabulary) for _ in range(30))[:130]
    made = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = made(60)
    # Alike at the start only; alike as wholes only; letters so common that autojunk drops them; half copies.
    texts = [start + made(40), start + made(40), "Another start of " + base, base, base[40:] + " tail", "ab" * 150, "ba" * 150, "ab" * 150 + "c", base[:200] + made(20), made(60)]
    texts += [" ".join(w if r.random() > 0.06 else r.choice(vocabulary) for w in base.split()) for _ in range(6)]
    assert sum(len(x) > 200 for x in texts) > 12
    brute = lambda rows, **k: {(i, j, round(x, 9)) for i, a in rows for j, b in rows if i < j and (x := difflib.SequenceMatcher(None, a, b, **k).ratio()) > 0.8}
    rows = list(enumerate(texts))
    want = brute(rows)
    # Without autojunk the second pair would match too.
    assert {p[:2] for p in brute(rows, autojunk=False)} - {p[:2] for p in want} >= {(2, 3)} and (0, 1) not in {p[:2] for p in want}
    found = lambda df: {(x["a"], x["b"], round(x["ratio"], 9)) for x in df.collect()}
    assert found(near_dup.sequence_near_dups(spark.createDataFrame(rows, "id bigint, t string"), "id", "t")) == want
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(i + 100000, x[3:] + "zz") for i, x in items]
    assert any(len(x) > 200 for _, x in items)
    assert found(registry.queries()["sequence_matcher_near_dup"](spark, "/root/testdata/sf0.001")) == brute(items)


def test_common_subsequence():
    def slow(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row = list(itertools.accumulate(range(len(y)), lambda left, j, old=row, a=a: old[j] + 1 if a == y[j] else max(old[j + 1], left), initial=0))
        return row[-1]

    r = random.Random(2)
    for _ in range(200):
        x, y = ("".join(r.choice("abc漢") for _ in range(r.randrange(12))) for _ in range(2))
        assert near_dup.common_subsequence(x, y) == slow(x, y), (x, y)


def test_deals(spark):
    sizes = {"train": 8, "val": 1, "test": 1}
    assert splits.seats({"train": 800, "val": 100, "test": 100}).tolist() == [0] * 8 + [1, 2]
    df = spark.createDataFrame([(i, i, "d") for i in range(12)], "id bigint, grp bigint, dom string").withColumn("pos", F.col("id"))
    a = {r["id"]: r["split"] for r in splits.deal(df, sizes, cluster="grp", domain="dom", pos="pos").collect()}
    b = {r["id"]: r["split"] for r in splits.deal(df, sizes, cluster="grp", domain="dom", pos="pos").collect()}
    assert a == b and len(a) == 12 and set(a.values()) == {"train", "val", "test"}
    for wave in (1, 3, 1000):
        assert {r["id"]: r["split"] for r in splits.deal(df, sizes, cluster="grp", domain="dom", pos="pos", wave=wave).collect()} == a
    r = random.Random(4)
    some, k = [], 0
    for c in range(150):
        for _ in range(r.choice([1, 1, 1, 2, 5])):
            some.append((k, c, "d"))
            k += 1
    df, sizes = spark.createDataFrame(some, "id bigint, grp bigint, dom string").withColumn("pos", F.col("id")), {"train": k * 8 // 10, "val": k // 10, "test": k // 10}
    size = Counter(c for _, c, _ in some)
    order = sorted(size, key=lambda c: hashlib.md5(f"7:{c}".encode()).hexdigest())
    split, room, at, round_ = {}, dict(sizes), 0, ["train"] * 8 + ["val", "test"]
    for c in order:
        ahead = [(at + j) % 10 for j in range(10)]
        fits = next((j for j in ahead if room[round_[j]] >= size[c]), None)
        split[c] = round_[fits] if fits is not None else max(sizes, key=lambda s: room[s])
        at = (fits + 1) % 10 if fits is not None else at
        room[split[c]] -= size[c]
    for wave, replay in ((1, 1), (7, 2), (40, 1), (1000, 8)):
        got = splits.deal(df, sizes, cluster="grp", domain="dom", pos="pos", wave=wave, replay=replay).select("grp", "split").distinct().collect()
        assert {x["grp"]: x["split"] for x in got} == split
    m = splits.majority_domain(spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "z", 2)], "c int, d string, p int"), "c", "d", "p")
    assert {r["c"]: r["domain"] for r in m.collect()} == {1: "b", 2: "z"}


def test_waves_of_clusters_against_one_at_a_time():
    r = random.Random(12)
    for _ in range(200):
        room = [r.randrange(1, 60) for _ in range(r.randrange(1, 4))]
        sizes = [r.choice([1, 1, 1, 2, 5, 9]) for _ in range(r.randrange(1, 120))]
        round_ = splits.seats({str(i): n for i, n in enumerate(room)})
        left, at, want = list(room), 0, []
        for n in sizes:
            for k in range(len(round_)):
                s = int(round_[(at + k) % len(round_)])
                if left[s] >= n:
                    at = (at + k + 1) % len(round_)
                    break
            else:
                s = left.index(max(left))
            left[s] -= n
            want.append(s)
        free, seat, got = np.array(room), 0, []
        cut = r.randrange(len(sizes) + 1)
        for part in (sizes[:cut], sizes[cut:]):
            out, free, seat = splits.deal_wave(np.array(part, np.int64), round_, free, seat)
            got += out.tolist()
        assert got == want and free.tolist() == left


def test_canonical_and_quota(spark):
    rows = [("r", "s", "docs/es/s"), ("r", "s", ".agents/skills/s"), ("r", "s", "skills/z/s"), ("r", "s", "skills/a/s"), ("q", "s", "lib/s")]
    got = {(r["repo"], r["relpath"]) for r in select.canonical(spark.createDataFrame(rows, "repo string, skill_name string, relpath string")).collect()}
    assert got == {("r", "skills/a/s"), ("q", "lib/s")}
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "id bigint, domain string")
    one, two = (sorted((r["domain"], r["id"]) for r in select.quota_sample(df, {"a": 4, "b": 9}).collect()) for _ in range(2))
    assert one == two and sum(d == "a" for d, _ in one) == 4 and sum(d == "b" for d, _ in one) == 3
    assert [tuple(r) for r in select.shortfalls(df, {"a": 4, "b": 9}).collect()] == [("b", 3, 9)]


def test_assembly(spark):
    sel = spark.createDataFrame([("a", 0, "d", "r"), ("b", 1, "d", "r"), ("c", 2, "d", "r"), ("e", 3, "d", "r"), ("f", 4, "d", "r")], "id string, _pos bigint, domain string, repo string")
    long = "please build something that does a great deal of work"
    ins = spark.createDataFrame([("a", f"  {long} "), ("b", long), ("c", "short"), ("f", long + " a description that is long")], "id string, instruction string")
    bps = spark.createDataFrame([("a", "x", "{}"), ("b", "x", "{}"), ("c", "x", "{}"), ("e", "x", "{}"), ("f", "a description that is long", "{}")], "id string, description string, blueprint string")
    records, errors = assemble.assemble(sel, ins, bps)
    assert sorted(tuple(r)[::2] for r in errors.collect()) == [("b", "duplicate instruction"), ("c", "instruction too short"), ("e", "missing instruction"), ("f", "instruction copies description")]
    with pytest.raises(ValueError, match="duplicate"):
        assemble.gate(records, errors)
    assert assemble.gate(records, errors.limit(0)).count() == 4


def test_dataset_checks(spark):
    import difflib

    from curatrix.plans import registry

    words = ("please build a report of weekly sales figures for the finance team", "translate customer letters into plain English and keep their tone", "summarise long meeting notes into decisions and open questions")
    texts = [words[0], words[1], words[2], words[0] + " now", words[1].upper()]
    sel = spark.createDataFrame([(k, i, "d", "r") for i, k in enumerate("edcba")], "id string, _pos bigint, domain string, repo string")
    ins = spark.createDataFrame(list(zip("edcba", texts, strict=True)), "id string, instruction string")
    good, files = {"name": "my-skill", "files": [{"path": "SKILL.md"}]}, [{"path": "SKILL.md"}]
    faults = [(good, {}), (good, {"validation_errors": ["x"]}), ({"name": "a--b", "files": files}, {"validation_errors": []}), (good | {"files": []}, {}), (good, {})]
    bps = spark.createDataFrame([(k, "x", json.dumps(b), json.dumps(p)) for k, (b, p) in zip("edcba", faults, strict=True)], "id string, description string, blueprint string, provenance string")
    records, errors = assemble.build(sel, ins, bps)
    assert sorted(tuple(r) for r in errors.collect()) == [("b", 3, "no files"), ("c", 2, "invalid name 'a--b'"), ("d", 1, "blueprint validation errors"), ("e", 0, "near-dup: e <-> b")]
    with pytest.raises(ValueError, match="near-dup: e <-> b"):
        assemble.gate(records, errors)
    only = lambda *ids: assemble.build(sel.where(F.col("id").isin(*ids)), ins, bps)
    assert [r["metadata"]["id"] for r in assemble.gate(*only("e", "a")).orderBy("_pos").collect()] == ["e", "a"]
    assert [r["error"] for r in assemble.build(sel.where("id = 'a'"), ins, bps.withColumn("blueprint", F.lit("{")))[1].orderBy("error").collect()] == ["invalid name ''", "no files"]

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(i + 100000, x[3:] + "zz") for i, x in items]
    want, seen = [], set()
    for i, x in items:
        x = x.strip()
        want += [(i, "instruction too short")] * (len(x) < 40) + [(i, "duplicate instruction")] * (x in seen)
        seen.add(x)
        want += [[], [(i, f"invalid name 'Item_{i}'")], [(i, "no files")], [(i, "blueprint validation errors")], []][i % 5]
        want += [(i, f"near-dup: {i} <-> {j}") for j, y in items if i < j and difflib.SequenceMatcher(None, x, y.strip()).ratio() > 0.8]
    assert sorted(tuple(r) for r in registry.queries()["dataset_errors"](spark, "/root/testdata/sf0.001").collect()) == sorted(want)


def test_sections_of_whole_documents(spark):
    import hashlib

    from curatrix.plans import registry

    folder = "/root/testdata/sf0.01"

    def paragraph(body):
        for chunk in re.split(r"\n\s*\n", body):
            chunk = chunk.strip()
            if chunk and not chunk.startswith(("#", "---")):
                return re.sub(r"\s+", " ", chunk)[:500]
        return ""

    def items(body, patterns):
        inside, out = False, []
        for line in map(str.strip, body.splitlines()):
            if line.startswith("#"):
                if inside:
                    break
                inside = any(re.search(p, line.lstrip("#").strip().lower()) for p in patterns)
            elif inside and line:
                out.append(re.sub(r"^(?:[-*]\s+|\d+[.)]\s+)", "", line).strip())
        return "|".join(filter(None, out))

    want, long = {}, 0
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        body = f"# Title\n\n{d['text']}\n\n## When to use\n- first\n* second\n1. third\nplain\n\n## When not to use\n- never\n"
        long += len(paragraph(body)) == 500
        want[d["doc_id"]] = (f"doc-{d['doc_id']}", items(body, ("when to use", "use cases?", "triggers?", "activat")), items(body, ("when not to use", "don'?t use", "limitations?", "out of scope", "not suitable", "avoid when")), hashlib.md5(paragraph(body).encode()).hexdigest())
    assert long > 0
    assert {r["doc_id"]: (r["name"], r["use"], r["not_use"], r["paragraph_md5"]) for r in registry.queries()["front_matter_sections"](spark, folder).collect()} == want


def test_whole_texts_are_instructions(spark):
    from curatrix.plans import registry

    texts = [r["text"].strip() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").where("doc_id % 11 <> 0 and doc_id % 7 <> 0").collect()]
    assert registry.queries()["assemble_errors"](spark, "/root/testdata/sf0.01").where("error = 'duplicate instruction'").count() == len(texts) - len(set(texts))


def test_conversion_and_repair(spark):
    main = "---\nname: Wrong_Name\ndescription: short\n---\n# T\n\nDoes things.\n\n## When to use\n- now\n"
    rows = [("own_repo", "skills/my_dir", "my_dir", main, [("SKILL.md", main), ("assets/x.png", None)])]
    df = spark.createDataFrame(rows, "repo string, relpath string, name string, main string, files array<struct<path:string,content:string>>")
    c = assemble.convert(df)
    r = c.first()
    assert r["id"] == "own_repo__my_dir" and r["blueprint"]["purpose"] == "Does things." and r["blueprint"]["when_to_use"] == ["now"] and r["blueprint"]["when_not_to_use"] == []
    assert r["blueprint"]["files"][1]["content"] == "" and r["blueprint"]["files"][1]["purpose"].endswith("(binary — content omitted)") and len(r["provenance"]["validation_errors"]) == 2
    assert r["provenance"]["skill_url"] == "https://skills.sh/own/repo/Wrong_Name" and r["provenance"]["license"] == "unknown"
    f = assemble.repair_names(c).first()
    assert f["blueprint"]["name"] == "my-dir" and "name: my-dir" in f["blueprint"]["files"][0]["content"] and f["provenance"]["validation_errors"] == [] and f["provenance"]["original_name"] == "Wrong_Name"


def test_expert_cases(spark):
    good = {"id": "E001", "instruction": "i", "source": "s", "source_skill": None, "difficulty": "d", "trap_type": None, "curation_notes": "n", "author": "me", "created": "c"}
    cases = [(good, []), (good | {"x": 1}, ["unexpected fields x"]), (good | {"id": "E1"}, ["id must match E###"]), (good | {"trap_type": "zzz"}, ["unknown trap_type"]), (good | {"source": " "}, ["blank source"]), (good | {"author": None}, ["field 'author' has wrong type"])]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(assemble.case_errors(F.col("c"), F.lit("E001"))).collect()]
    assert got == [w for _, w in cases]
    assert assemble.missing_cases(spark.createDataFrame([("E003",)], "id string")).count() == 19


def test_attempts(spark):
    rows = [(1, 1, "a", True, False), (2, 1, "a", False, False), (2, 2, "b", True, False), (3, 1, "a", False, False), (3, 2, "b", False, False), (3, 3, "c" * 3000, False, False), (4, 1, None, False, True)]
    df = spark.createDataFrame(rows, "request_id int, attempt int, output string, valid boolean, failed boolean")
    got = {r["request_id"]: (r["status"], r["n_attempts"], r["output"]) for r in assemble.attempt_status(df).collect()}
    assert got == {1: (200, 1, "a"), 2: (200, 2, "b"), 3: (422, 3, "c" * 2000), 4: (502, 1, None)}
    fake = spark.range(1, 4).select(assemble.canned(["x", "y"], F.col("id").cast("int")))
    assert [r[0] for r in fake.collect()] == ["x", "y", "y"]


def test_attempts_of_all_events(spark):
    from curatrix.plans import registry

    folder = "/root/testdata/sf0.01"
    requests = {}
    for e in spark.read.parquet(f"{folder}/events.parquet").collect():
        requests.setdefault(e["event_id"] // 4, {})[e["event_id"] % 4 + 1] = e
    want = {}
    for k, tries in requests.items():
        for a in sorted(tries):
            if a > 3:
                break
            if tries[a]["event_type"] == "error":
                want[k] = (502, a, None)
                break
            if tries[a]["event_type"] == "purchase":
                want[k] = (200, a, tries[a]["props"])
                break
            want[k] = (422, a, tries[a]["props"] and tries[a]["props"][:2000])
    assert len(want) == 2500
    assert {r["request_id"]: (r["status"], r["n_attempts"], r["output"]) for r in registry.queries()["repair_loop_status"](spark, folder).collect()} == want


def test_masking(spark):
    df = spark.createDataFrame([("p", "p a\n<|im_end|>\n"), ("q", "p a<|im_end|>"), ("p", "p a")], "pr string, full string")
    ids, labels = prep.example(prep.regex_tokens(F.col("full")), prep.regex_tokens(F.col("pr")))
    rows = df.select(ids.alias("ids"), labels.alias("labels"), prep.unmasked(ids, labels).alias("text")).collect()
    assert rows[0]["ids"][-1] == prep.EOS and rows[0]["labels"][0] == "-100" and rows[0]["text"] == " a\n<|im_end|>"
    assert rows[1]["ids"] is None and rows[2]["ids"] is None
    with pytest.raises(ValueError):
        prep.prompt(F.lit("x"), [("a", "b")], "few-shot")
    with pytest.raises(ValueError):
        prep.select_examples(df, "random", 1, length="pr", pos="pr")


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (5, ""), (10, None)], "n int, dom string")
    assert {tuple(r) for r in profile.domain_counts(df, "dom").collect()} == {("a", 1), ("unknown", 2)}
    k = profile.filter_lengths(df, "n", 5)
    assert tuple(profile.kept_report(k).first()) == (3, 2, 1) and [r["n"] for r in profile.dropped_keys(k, "n").collect()] == [10]
    h = spark.range(800).select(F.col("id").alias("n"))
    assert profile.nearest_index(h, "n", 0.9).first()["value"] == 720
    stats, hist = profile.blueprint_stats(spark.createDataFrame([(json.dumps(GOOD),), ("{",), ("[]",), (variant(files=[]),)], "b string"), "b")
    assert tuple(stats.first()) == (4, 2, 1) and {tuple(r) for r in hist.collect()} == {(2, 1), (0, 1)}
    assert profile.mode(hist, "n_files", "n").first()[0] == 0


def test_configs(spark):
    flat = assemble.flatten_config({"a": {"b": 1, "c": [1, 2]}, "d": None})
    assert flat == {"a.b": 1, "a.c": [1, 2], "d": None}
    kv = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    got = assemble.config_diff(kv({"x": "1", "y": "2"}), kv({"x": "1", "y": "3", "z": "4"})).collect()
    assert {r["key"] for r in got} == {"y", "z"}


def test_contract_lint(spark):
    full = "".join(f"## {i + 1}. {t}\n\n> guidance\n\n- said [USER]\n" for i, t in enumerate(contracts.SECTIONS))
    cases = {
        "full": full,
        "windows": full.replace("\n", "\r\n"),
        "no_number": full.replace("## 3. Negative triggers", "## NEGATIVE triggers. "),
        "no_crazy": full.replace("## 16. Crazy Thing\n\n> guidance\n\n- said [USER]\n", ""),
        "two": full.replace("- said [USER]", "- said [USER] [OPEN]", 1),
        "paragraphs": full.replace("- said [USER]", "A line\ngoes on [OPEN]\n\n   and on\n\nAnother\n### deeper\nThird [ASSUMED]\n\n-\n1.\n", 1),
        "renamed": full.replace("## 11. Stopping conditions", "## 11. Stops"),
        "empty": "",
        "null": None,
    }
    df = spark.createDataFrame(list(cases.items()), "id string, x string")
    got = {r["id"]: r["lint"] for r in contracts.lint(df, "x").collect()}
    assert [k for k, v in got.items() if v["finished"]] == ["full", "windows", "no_number", "no_crazy"]
    assert got["full"]["n_statements"] == got["full"]["n_user"] == 17 and got["no_crazy"]["n_user"] == 16
    assert (got["two"]["n_overlabelled"], got["two"]["n_user"]) == (1, 16)
    p = got["paragraphs"]
    assert (p["n_statements"], p["n_open"], p["n_unlabelled"], p["n_assumed"]) == (19, 1, 1, 1)
    assert got["renamed"]["missing"] == ["stopping conditions"] and got["renamed"]["n_statements"] == 17
    assert len(got["empty"]["missing"]) == 16 and got["empty"] == got["null"]
    assert contracts.lint(df.limit(0), "x").count() == 0
