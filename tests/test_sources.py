"""Readers, writers and streams on small folders."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from curatrix.functions import stats, text
from curatrix.operators import assemble, profile, splits
from curatrix.sources import readers, writers
from curatrix.streaming import jobs


def record(i):
    return {"instruction": f"ask {i}", "expected_blueprint": "{}", "metadata": {"id": f"r{i}", "domain": "d", "repo": "x"}}


@pytest.fixture
def folder(tmp_path):
    k = 0
    for shard in range(2):
        lines = []
        for _ in range(3):
            lines.append(json.dumps(record(k)))
            k += 1
        (tmp_path / f"train_shard_0{shard}.jsonl").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "val.jsonl").write_text(json.dumps(record(10)) + "\n")
    (tmp_path / "test.jsonl").write_text(json.dumps(record(11)) + "\n")
    (tmp_path / "manifest.json").write_text(json.dumps({"files": {"train": ["train_shard_01.jsonl"], "val": ["val.jsonl"]}}))
    return str(tmp_path)


def ids(df):
    return [r[0] for r in df.orderBy("_pos").select("metadata.id").collect()]


def test_splits(spark, folder):
    assert ids(readers.split_records(spark, folder, "train")) == [f"r{i}" for i in range(6)]
    assert ids(readers.split_records(spark, folder, "train", 4)) == ["r0", "r1", "r2", "r3"]
    assert ids(readers.manifest_split(spark, folder, "train")) == ["r3", "r4", "r5"]
    assert ids(readers.final_test(spark, folder)) == ["r11"]
    assert readers.all_splits(spark, folder).groupBy("split").count().count() == 3
    with pytest.raises(PermissionError):
        readers.manifest_split(spark, folder, "test")
    with pytest.raises(ValueError):
        readers.split_records(spark, folder, "dev")


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"instruction": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(tmp_path / "x.jsonl")).collect()


def test_maps_and_items(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": "1", "y": "2"}')
    (tmp_path / "b.json").write_text('{"y": "3"}')
    got = readers.json_map(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert {tuple(r) for r in got.collect()} == {("x", "1"), ("y", "3")}
    (tmp_path / "l.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "o.json").write_text('{"n": 1, "items": [{"id": 3}]}')
    assert readers.items(spark, str(tmp_path / "l.json")).count() == 2
    assert readers.items(spark, str(tmp_path / "o.json")).count() == 1


def test_maps_and_items_in_many_files(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("k"), F.concat(F.lit("v\n"), "id").alias("v"))
    writers.json_map(df, f"{tmp_path}/m", "k", "v", 40)
    assert len(list((tmp_path / "m").glob("part=*/part-*"))) == 8
    got = readers.json_map(spark, [f"{tmp_path}/m"])
    assert {tuple(r) for r in got.collect()} == {(str(i), f"v\n{i}") for i in range(300)}
    for under in (None, "items"):
        writers.json_items(df, f"{tmp_path}/i{under}", "k", under, 70)
        found = readers.items(spark, f"{tmp_path}/i{under}")
        assert {r[0] for r in found.select(F.try_variant_get("item", "$.k", "bigint")).collect()} == set(range(300)) and found.select("_pos").distinct().count() == 300
    writers.json_map(df.limit(0), f"{tmp_path}/none", "k", "v")
    assert readers.json_map(spark, [f"{tmp_path}/m", f"{tmp_path}/m"]).count() == 300


def test_config_is_a_mapping(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("a: 1\nb:\n  c: [x, y]\n  d: null\n")
    found = readers.config(spark, str(tmp_path / "c.yaml"))
    assert found == {"a": 1, "b": {"c": ["x", "y"], "d": None}} and assemble.flatten_config(found) == {"a": 1, "b.c": ["x", "y"], "b.d": None}
    (tmp_path / "l.yaml").write_text("- a\n")
    with pytest.raises(ValueError, match="not a mapping"):
        readers.config(spark, str(tmp_path / "l.yaml"))
    texts = ["a: 1\nb:\n  c: [x]\n  d: yes", "- a", "a: [", "", None, "1: x\n2.5: y"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").coalesce(1).select(text.yaml_settings("x")).collect()]
    assert got == [{"a": "1", "b.c": "['x']", "b.d": "True"}, None, None, None, None, {"1": "x", "2.5": "y"}]


def test_bundles_move_only_what_belongs_to_one(spark):
    files = [("r/a/SKILL.md", b"main"), ("r/a/x/y.md", b"deep"), ("r/a/sub/SKILL.md", b"inner"), ("r/a/sub/z", b"\x00"), ("r/none/big.bin", b"z" * 100_000), ("SKILL.md", b"top"), ("r/.git/SKILL.md", b"no")]
    df = spark.createDataFrame(files, "rel string, content binary")
    got = {r["name"]: (r["main"], [tuple(f) for f in r["files"]]) for r in readers.bundles_of(df.where("rel <> 'SKILL.md'")).collect()}
    assert got == {"a": ("main", [("SKILL.md", "main"), ("sub/SKILL.md", "inner"), ("sub/z", None), ("x/y.md", "deep")]), "sub": ("inner", [("SKILL.md", "inner"), ("z", None)])}
    top = next(r for r in readers.bundles_of(df).collect() if r["main"] == "top")
    assert top["name"] == "" and len(top["files"]) == 6 and readers.bundles_of(df.limit(0)).isEmpty()


def test_bundles_and_licences(spark, tmp_path):
    for p, content in {
        "own_repo/skills/a/SKILL.md": b"---\nname: a\n---\nx", "own_repo/skills/a/scripts/run.py": b"print()", "own_repo/skills/a/assets/i.png": b"\x89\x00", "own_repo/.git/skills/z/SKILL.md": b"no",
        "own_repo/LICENSE": b"MIT", "own_repo/skills/a/COPYING": b"odd", "own_repo/skills/a/LICENSE.md": b"BSD", "b/SKILL.md": b"top \xff",
    }.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content)
    rows = {r["name"]: r for r in readers.bundles(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["repo"] == "own_repo" and rows["a"]["relpath"] == "skills/a"
    assert [f["path"] for f in rows["a"]["files"]] == ["COPYING", "LICENSE.md", "SKILL.md", "assets/i.png", "scripts/run.py"] and rows["a"]["files"][3]["content"] is None
    assert rows["b"]["main"] == "top �"
    found = {r["dir"].rsplit("/", 1)[-1]: r["text"] for r in readers.licences(spark, str(tmp_path), text.SELECTOR_LICENCE_FILES).collect()}
    assert found == {"own_repo": "MIT", "a": "BSD"}


def test_cases_and_questions(spark, tmp_path):
    (tmp_path / "E001.json").write_text("{}")
    (tmp_path / "_template.E000.json").write_text("{}")
    assert [r["stem"] for r in readers.expert_cases(spark, str(tmp_path)).collect()] == ["E001"]
    local = spark.createDataFrame([("q", ["a", "b"], 1, "t")], "question string, options array<string>, answer int, topic string")
    assert readers.questions(spark, None, local).count() == 1
    assert readers.questions(spark, str(tmp_path / "absent.json"), local).first()["question"] == "q"
    rows = [{"question": "p", "labels": ["A", "B"], "options": ["1", "2"], "key": "B"}, {"question": "bad", "labels": ["A"], "options": ["1", "2"], "key": "C"}, {"question": "one", "labels": ["A"], "options": ["1"], "key": "A"}]
    (tmp_path / "q.json").write_text("\n".join(map(json.dumps, rows)))
    got = readers.questions(spark, str(tmp_path / "q.json"), local).collect()
    assert [(r["question"], r["answer"]) for r in got] == [("p", 1)]


def test_profile_of_any_number_of_domains(spark, tmp_path):
    d = spark.range(3000).select((F.col("id") % 1000).alias("n_chars"), F.concat(F.lit("d"), F.col("id") % 1000).alias("domain"), "id", F.lit('{"files": []}').alias("bp"))
    tables = stats.length_stats(d, "n_chars"), stats.truncation(d, "n_chars", (10, 999)), profile.domain_counts(d), profile.longest(d.select("id", "n_chars"), "n_chars", "id"), *profile.blueprint_stats(d, "bp")
    text, data = writers.eda_report(*tables)
    assert len(data["Domains"]) == 1000 and data["Domains"][0] == {"domain": "d0", "n": 3} and text.count("| d") == 1001 and text.startswith("# Profile\n\n## Lengths\n\n| n_records |")
    writers.write_report(f"file://{tmp_path}/r", "Profile", writers.profile_parts(*tables))
    files = sorted((tmp_path / "r/page").glob("part-*"))
    assert "".join(f.read_text() for f in files) == text
    assert spark.read.json(str(tmp_path / "r/rows/section=Domains")).count() == 1000
    assert sorted(x.name for x in (tmp_path / "r/rows").glob("section=*")) == [f"section={x}" for x in sorted(data)]


def test_split_folder_and_manifest(spark, tmp_path):
    df = spark.range(250).select(F.col("id").alias("pos"), F.concat(F.lit("x"), F.repeat(F.lit("y"), (F.col("id") % 7).cast("int"))).alias("rec"), F.when(F.col("id") < 230, "train").otherwise("val").alias("split"))
    m = writers.split_folder(df, str(tmp_path / "out"), record="rec", pos="pos", seed=7)
    rows = {r["file"]: r for r in m.collect()}
    assert len(rows) == 4 and sum(r["n_lines"] for r in rows.values()) == 250 and rows["split=val/shard=0"]["n_lines"] == 20
    sizes = sorted(r["n_lines"] for f, r in rows.items() if "train" in f)
    assert sizes == [76, 77, 77]


def test_large_files_are_hashed_as_trees(spark, tmp_path):
    lines = [f"line {i}" * (i % 5) for i in range(20_000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines))
    (tmp_path / "small.jsonl").write_text("{}\n")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    hashes = [sha(x) for x in lines]
    want = sha("\n".join(sha("\n".join(hashes[i : i + splits.LEAF_LINES])) for i in range(0, len(hashes), splits.LEAF_LINES)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    for size in ("20k", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got.append({r["file"]: (r["sha256"], r["n_lines"]) for r in splits.manifest(spark, str(tmp_path), whole=1000).collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1] == {"big.jsonl": (want, 16_000), "small.jsonl": (sha("{}\n"), 1)}
    kept = spark.createDataFrame([(f, *x) for f, x in got[0].items()], "file string, sha256 string, n_lines bigint")
    assert splits.verify(spark, str(tmp_path), kept, whole=1000)
    lines[15_000], lines[15_001] = lines[15_001], lines[15_000]
    (tmp_path / "big.jsonl").write_text("\n".join(lines))
    assert not splits.verify(spark, str(tmp_path), kept, whole=1000)


def test_manifest_verification(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}\n{}\n")
    (tmp_path / "b.jsonl").write_text("{}\n")
    m = spark.createDataFrame([tuple(r) for r in splits.manifest(spark, str(tmp_path)).collect()], "file string, sha256 string, n_lines bigint")
    assert splits.verify(spark, str(tmp_path), m)
    (tmp_path / "b.jsonl").write_text("[]\n")
    assert not splits.verify(spark, str(tmp_path), m)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("E1", 2.0)], "code string, n double")
    assert "| E1 | 2.0000 |" in writers.markdown_table(df) and "## Worst" in writers.failures_report(df, df, df, df)
    assert "- n: 2.0000" in writers.comparison_report(df)
    assert writers.markdown_table(spark.range(300)).count("\n") == 301
    assert writers.is_smoke("small", "big", None, 10) and writers.is_smoke("big", "big", 5, 10) and not writers.is_smoke("big", "big", 10, 10)
    writers.jsonl(df, str(tmp_path / "j"), ["code"])
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_blueprints_are_written_to_few_files(spark, tmp_path, monkeypatch):
    from curatrix.plans import source_queries

    monkeypatch.setattr(source_queries, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    got = source_queries.blueprint_files(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and len(list((tmp_path / "blueprints").rglob("part-*"))) <= 20
    df = spark.createDataFrame([("a", ("x\ny\u2028z",), (None,)), ("b", (None,), ("mit",))], "id string, blueprint struct<name string>, provenance struct<license string>")
    writers.blueprint_lines(df, str(tmp_path / "lines"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "lines"))
    assert [r["blueprint"] and r["blueprint"]["name"] for r in back.orderBy("id").collect()] == ["x\ny\u2028z", None]
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_stream_lets_old_requests_go(spark, tmp_path):
    start, schema = 1_700_000_000, "request_id bigint, attempt int, output string, valid boolean, failed boolean, ts timestamp"
    rows = [(i // 2, i % 2 + 1, f"o{i}", i % 7 == 3, i % 11 == 5, start + 600 * i) for i in range(400)]
    held = []
    for part in range(4):
        some = [(*r[:5], datetime.datetime.fromtimestamp(r[5], datetime.UTC)) for r in rows[part * 100 + (part > 0) : part * 100 + 101]]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = jobs.status_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", time="ts", wait="1 hour")
        query.awaitTermination()
        held.append(query.lastProgress.stateOperators[0].numRowsTotal)
    want = assemble.attempt_status(spark.createDataFrame(rows, "request_id bigint, attempt int, output string, valid boolean, failed boolean, ts bigint"))
    key = lambda df: sorted(tuple(r[c] for c in ("request_id", "status", "n_attempts", "output")) for r in df.collect())
    assert key(jobs.statuses(spark, f"{tmp_path}/out")) == key(want)
    # 200 requests came; the state holds those of the last two waits, 12 attempts and what the last batch brought.
    assert max(held) <= 60 and held[-1] < 60
    # What comes after the watermark is late.
    late = [(0, 3, "late", True, False, datetime.datetime.fromtimestamp(start, datetime.UTC))]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    jobs.status_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", time="ts", wait="1 hour").awaitTermination()
    assert key(jobs.statuses(spark, f"{tmp_path}/out")) == key(want)


def test_stream_loses_no_request_where_ids_dont_follow_time(spark, tmp_path):
    from curatrix.plans import score_queries, source_queries

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 80")
    e.unionByName(e.withColumn("event_id", F.col("event_id") + 80)).write.parquet(f"{tmp_path}/events.parquet")
    want = score_queries.repair_loop_status(spark, str(tmp_path)).collect()
    got = source_queries.repair_loop_stream(spark, str(tmp_path)).collect()
    assert len(want) == 40 and sorted(tuple(r.asDict().items()) for r in got) == sorted(tuple(r.asDict().items()) for r in want)


def test_stream_keeps_its_state_without_python(spark, tmp_path):
    schema = "request_id bigint, attempt int, output string, valid boolean, failed boolean, ts timestamp"
    day = lambda n: datetime.datetime.fromtimestamp(1_700_000_000 + 86_400 * n, datetime.UTC)
    # Request 1 comes again when its first attempt has long left the state; 2 has an attempt without a time.
    parts = [[(1, 1, "a", True, False, day(0)), (2, 1, "b", False, False, None)], [(3, 1, "c", False, True, day(3))], [(1, 2, "d", False, True, day(5)), (2, 2, "e" * 2001, False, False, None)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = jobs.status_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", time="ts", wait="1 hour")
        query.awaitTermination()
    assert query.lastProgress.stateOperators[0].operatorName == "stateStoreSave" and query.lastProgress.stateOperators[0].numRowsTotal <= 3
    got = {r["request_id"]: tuple(r)[1:] for r in jobs.statuses(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (200, 1, "a"), 2: (422, 2, "e" * 2000), 3: (502, 1, None)}
    assert got == {r["request_id"]: tuple(r)[1:] for r in assemble.attempt_status(spark.createDataFrame(sum(parts, []), schema)).collect()}


def test_stream_of_repeated_attempts_takes_the_first_valid_and_the_last_output(spark, tmp_path):
    schema = "request_id int, attempt int, output string, valid boolean, failed boolean"
    for rows in ([(1, 1, "z", True, False), (2, 1, "z", False, False)], [(1, 1, "a", True, False), (2, 1, "a", False, False), (2, 4, "over", True, False), (3, 4, "over", True, False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.status_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {tuple(r) for r in jobs.statuses(spark, f"{tmp_path}/out").collect()} == {(1, 200, 1, "z"), (2, 422, 1, "a")}


def test_failures_are_listed_whole(spark, tmp_path):
    counts = spark.createDataFrame([("E1", 300), ("E2", 0)], "code string, n bigint")
    ids = lambda n: spark.range(n).select(F.format_string("i%04d", F.col("id")).alias("id"))
    worst = ids(450).withColumn("codes", F.array(F.lit("E1"), F.lit("E2"))).orderBy(F.desc("id"))
    table = ["## Counts", "", "| code | n |", "| --- | --- |", "| E1 | 300 |", "| E2 | 0 |"]
    section = lambda title, n, more="": ["", f"## {title}", "", f"Count: {n}", "", *(f"- `i{i:04d}`{more}" for i in range(n))]
    want = [*table, *section("Best", 250), *section("Worst", 450, " — E1, E2"), *section("Regressions", 300), *section("New failures", 0)]
    got = writers.failures_report(counts, worst, ids(300), ids(0), ids(250))
    assert got == "\n".join(want) + "\n"
    writers.write_failures(str(tmp_path / "f"), counts, worst, ids(300), ids(0), ids(250))
    assert "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*"))) == got
    assert "Count" not in writers.failures_report(counts, worst).split("## Regressions")[1] and "No comparison run provided." in writers.failures_report(counts, worst)


def test_streams(spark, tmp_path):
    good = json.dumps({"name": "a"})
    spark.createDataFrame([("1", good), ("2", "no")], "id string, output string").write.parquet(str(tmp_path / "in"))
    refs = spark.createDataFrame([("1", good, 0), ("2", good, 1)], "id string, ref string, _pos bigint")
    stream = spark.readStream.schema("id string, output string").parquet(str(tmp_path / "in"))
    jobs.score_stream(stream, refs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["id"]: r["l1_parse"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"1": True, "2": False}
    spark.createDataFrame([(1, 1, "x", True, False), (2, 1, "y", False, False)], "request_id int, attempt int, output string, valid boolean, failed boolean").write.parquet(str(tmp_path / "att"))
    stream = spark.readStream.schema("request_id int, attempt int, output string, valid boolean, failed boolean").parquet(str(tmp_path / "att"))
    jobs.status_stream(stream, str(tmp_path / "st"), str(tmp_path / "cp2")).awaitTermination()
    assert {r["request_id"]: r["status"] for r in jobs.statuses(spark, str(tmp_path / "st")).collect()} == {1: 200, 2: 422}
    # Attempts that come later change what their requests have come to, and nothing is read again.
    more = [(2, 2, "z", True, False), (2, 4, "over", False, True), (3, 1, None, False, True)]
    spark.createDataFrame(more, "request_id int, attempt int, output string, valid boolean, failed boolean").write.mode("append").parquet(str(tmp_path / "att"))
    jobs.status_stream(stream, str(tmp_path / "st"), str(tmp_path / "cp2")).awaitTermination()
    got = {r["request_id"]: (r["status"], r["n_attempts"], r["output"]) for r in jobs.statuses(spark, str(tmp_path / "st")).collect()}
    assert got == {1: (200, 1, "x"), 2: (200, 2, "z"), 3: (502, 1, None)}
