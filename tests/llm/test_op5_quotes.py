import duckdb
import pytest

from curatrix.llm import op5_quote_links as op

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv int"
ROWS = [
    (1, 0, "user", "Hello there, how are you?\n\nSecond paragraph here."), (1, 1, "assistant", "> Hello there, how  are you?\nFine."), (1, 2, "user", "unrelated"),
    (1, 3, "user", "> > Hello there, how are you?\n> Fine.\nGood.\n>Second paragraph here."), (1, 4, "assistant", ">> Fine.\n> Good.\nok"), (1, 5, "user", "> nobody said this thing ever\nx"),
    (1, 6, "user", ">Hello there, how are you?\n> and something else\ny"), (2, 0, "user", None), (2, 1, "a", ""), (2, 2, None, "> "), (2, 3, "u", "a\n> \nb > c"), (3, 0, "user", "self\n> self"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


SHORT = [
    (1, 0, "u", "Sounds good.\nI will bring tea.\nSee you at 5."), (1, 1, "u", "Fine.\nAnd a line that is long enough to link."), (1, 2, "u", "> Sounds good.\n> See you at 5.\nyes"),
    (1, 3, "u", "> Sounds good.\n> Fine.\ntwo sources"), (1, 4, "u", "> Sounds good.\n> Nobody said so.\nno"), (1, 5, "u", "> See you at 5.\n\n> Sounds good.\n> And a line that is long enough to link.\nmixed"),
    (1, 6, "u", ">> Sounds good.\n>>\n>> See you at 5.\ndeeper"), (2, 0, "u", "> Later one.\n> Later two."), (2, 1, "u", "Later one.\nBetween.\nLater two."),
]


def test_names_that_clash(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id bigint, turn bigint, role string, `the.text` string, Text string, TURN int")
    out = op.link_quotes(df, text="the.text")
    assert sorted(map(str, out.collect())) == sorted(map(str, op.link_quotes(frame(spark, ROWS)).collect()))


@pytest.mark.parametrize("rows", [ROWS, SHORT])
def test_against_sql(spark, rows):
    df = frame(spark, rows)
    out = op.link_quotes(df)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = con.sql(op.ORACLE)
    cols = sorted(out.columns)
    assert sorted(str([r[c] for c in cols]) for r in out.collect()) == sorted(str([x[want.columns.index(c)] for c in cols]) for x in want.fetchall())


def test_reply_order(spark):
    rows = {(r["conv_id"], r["turn"]): r for r in op.link_quotes(frame(spark, ROWS)).collect()}
    assert [t for c, t in sorted((k for k in rows if k[0] == 1), key=lambda k: rows[k]["position"])] == [0, 1, 3, 4, 6, 2, 5]
    assert rows[1, 4]["reply_to"] == 3 and rows[1, 4]["depth"] == 2 and rows[1, 4]["text"] == "ok"
    assert rows[1, 5]["reply_to"] is None and rows[1, 5]["n_quotes"] == 1 and rows[1, 6]["reply_to"] == 0


def test_long_chain_of_replies(spark):
    rows = [(9, 0, "u", "the opening statement number 0")] + [(9, i, "u", f"> the opening statement number {i - 1}\nthe opening statement number {i}") for i in range(1, 40)]
    got = {r["turn"]: r for r in op.link_quotes(frame(spark, rows)).collect()}
    assert all(got[i]["depth"] == i and got[i]["thread"] == 0 and got[i]["position"] == i for i in range(40))


def test_short_lines_of_one_source(spark):
    rows = [
        (1, 0, "u", "Sounds good.\nI will bring tea.\nSee you at 5."), (1, 1, "u", "Fine.\nAnd a line that is long enough to link."),
        (1, 2, "u", "> Sounds good.\n> See you at 5.\nyes"), (1, 3, "u", "> Sounds good.\n> Fine.\ntwo sources"), (1, 4, "u", "> Sounds good.\n> Nobody said so.\nno"),
        (1, 5, "u", "> See you at 5.\n\n> Sounds good.\n> And a line that is long enough to link.\nmixed"), (1, 6, "u", ">> Sounds good.\n>>\n>> See you at 5.\ndeeper"),
        (2, 0, "u", "> Later one.\n> Later two."), (2, 1, "u", "Later one.\nBetween.\nLater two."),
        # Two messages of one turn, of which only one quotes what was said.
        (3, 0, "u", "One.\nTwo.\nThree."), (3, 1, "a", "> One.\n> Three."), (3, 1, "b", "> One.\n> Four."),
    ]
    got = {}
    for r in op.link_quotes(frame(spark, rows)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["reply_to"], r["n_linked"]))
    assert got[1, 2] == [(0, 1)] and got[1, 3] == [(None, 0)] and got[1, 4] == [(None, 0)] and got[1, 6] == [(0, 1)] and got[2, 0] == [(None, 0)]
    assert got[1, 5] == [(1, 2)] and got[3, 1] == [(0, 1)] * 2


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, "> q"), (None, 1, "u", "q"), (None, 1, "u", "q")]
    got = op.link_quotes(frame(spark, rows)).collect()
    assert sorted(r["position"] for r in got) == [0, 1, 2] and all(r["reply_to"] is None for r in got)
    assert op.link_quotes(frame(spark, ROWS).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op.link_quotes(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
