import itertools
import random
import re
import time

import numpy as np
import pytest

from curatrix.llm import op7_html_main as op


@pytest.fixture(scope="module")
def trees():
    return op.default_model()


def main(trees, *pages):
    return op.extract_batch(list(pages), trees)


def test_decoding_against_all_sets():
    r = random.Random(5)
    for _ in range(60):
        n = r.randrange(1, 9)
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        score = np.array([r.uniform(-1, 1) for _ in range(n)])
        legal = [k for k in itertools.product([False, True], repeat=n) if k[0] and all(not k[i] or k[parent[i]] for i in range(1, n))]
        best = max(sum(s for s, x in zip(score, k, strict=True) if x) for k in legal)
        got = op.decode(score, parent)
        assert tuple(got.tolist()) in legal and abs(score[got].sum() - best) < 1e-9


def test_held_out_pages(trees):
    r = np.random.default_rng(123)
    same = total = 0
    for _ in range(120):
        p = op.Page(op.made_page(r), labelled=True)
        y, k = op.labels(p), op.decode(trees.score(op.features(p)), p.parent)
        same += sum(len(s) for n, s in p.runs if bool(y[n]) == bool(k[n]))
        total += sum(len(s) for _, s in p.runs)
    assert same / total > 0.97


def test_tree_scores_match_a_walk(trees):
    r = np.random.default_rng(1)
    x = np.concatenate([op.features(op.Page(op.made_page(r))) for _ in range(3)])
    for row, want in zip(x[:40], trees.score(x)[:40], strict=True):
        total = trees.prior
        for f, c, v in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + bool(row[f[node]] > c[node])
            total += v[node - len(f)]
        assert abs(total - want) < 1e-9


ARTICLE = "<h1>Title &amp; more</h1><p><b>First line, here.<br><p>Second   paragraph\nof text, with a <a href='/x'>link</a>.</p><ul><li>One item.<li>Two items.</ul>"
PAGE = f"<html><head><title>no</title><style>p{{}}</style></head><body><nav class='menu'><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><div class=ad>Buy now.</div><article>{ARTICLE}</article><div class='comments'><p>Nice post, thanks.</p></div><aside class='sidebar'><p>Related story</p></aside><footer>&copy; us</footer><script>var t='<p>x</p>';</script></body></html>"


def test_page(trees):
    want = "Title & more\nFirst line, here.\nSecond paragraph of text, with a link.\nOne item.\nTwo items."
    assert main(trees, PAGE) == [want]
    assert main(trees, PAGE, PAGE) == [want, want]


def test_odd_pages(trees):
    deep = "<div>" * 20000 + "<p>x</p>"
    got = main(trees, None, "", "<", "<!-- open", "<script>never closed", deep, "</p></div>", "<p>" * 3000 + "<article><p>" + "word " * 40000)
    assert got[:2] == ["", ""] and got[3] == "" and got[2] in ("", "<")
    assert got[4] == "" and isinstance(got[5], str) and got[6] == ""


def test_nothing_is_skipped_but_raw_text(trees):
    prose = "Some words of an article, long enough to be one. More of them follow here, and again."
    body = lambda x: f"<html><head><title>no</title></head><body><article><h1>Title</h1><p>{prose}</p>{x}<p>{prose} Last.</p></article></body></html>"
    for name in ("math", "object", "canvas", "svg", "noscript", "template"):
        for end in (f"</{name}>", ""):
            [got] = main(trees, body(f"<p>Before it, <{name}><b>inner</b>{end} and after it.</p>"))
            assert "Before it, inner and after it." in got and got.count(prose) == 2, (name, end, got)
    # Each option is a node, and an unclosed select ends with what holds it.
    page = op.Page(body("<div><select><option>One<option>Two</div>"))
    assert [s for _, s in page.runs] == ["Title", prose, "One", "Two", f"{prose} Last."]
    assert [page.tag[n] for n, s in page.runs if s in ("One", "Two")] == ["option", "option"]
    # No </head>, and a header further down; names that only begin like a raw element's.
    [got] = main(trees, f"<html><head><title>no</title><body><article><p>{prose} First.</p><header><h1>Title</h1></header><p>{prose}</p></article>")
    assert "First." in got and "no" not in got.split("\n")
    [got] = main(trees, body("<script>var a = '</scripts>'; secret()</script>"))
    assert "secret" not in got and got.count(prose) == 2
    assert "hidden" not in main(trees, body("<style>hidden"))[0]


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "a"), (2, None, None, "b"), (1, "u", PAGE, "c")], "page_id bigint, url string, html string, text string")
    rows = op.main_text(df).collect()
    assert [r["text"] for r in rows] == ["a", "b", "c"] and rows[1]["_main_text"] == "" and rows[0]["_main_text"] == rows[2]["_main_text"] != ""
    assert op.main_text(df.limit(0)).count() == 0


def test_articles_of_the_tables(spark):
    out = op.op7_html_main(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert len(rows) == 50 and all(r["n_chars"] == len(r["text"]) and r["text"] for r in rows)
    assert not any("©" in r["text"] or "track(" in r["text"] for r in rows)


WRITTEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|[!?/][^>]*(?:>|\Z))""", re.S)


def test_tags_against_one_pattern():
    r = random.Random(3)
    parts = ["<", "<a", "<p", "</p", "<!", "<!--", "-->", "<?", ">", ">", '"', "'", "=", "x", " ", "/", "<b>", '<a href="u">', "\n", "é"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(25)))
        want = [(m.start(), m.end(), m[1] or "", m[2], m[3] or "") for m in WRITTEN.finditer(t)]
        got, markup, at = [], op.Markup(t), 0
        while m := markup.tag(at):
            got.append(m)
            at = m[1]
        assert got == want, t


def test_open_ends_take_linear_time(trees):
    n = 100_000
    began = time.time()
    for part in ('<a "', "<a '", "<a \"x'", "<a", "<", "<title>", "<p x='\"", '<a "\'', "<!--", "<a href=x "):
        assert isinstance(main(trees, part * n)[0], str)
    assert time.time() - began < 60


def test_attributes_named_like_labels(trees):
    [got] = main(trees, PAGE.replace("<article>", "<article data-y='none'>"))
    assert got == main(trees, PAGE)[0]


def test_clashing_columns_and_names_with_dots(spark):
    df = spark.createDataFrame([(1, PAGE, 7, 8)], "`k.id` int, `x.html` string, _main_text int, c1 int")
    r = op.main_text(df, html="x.html")
    assert r.columns == [*df.columns, "__main_text"] and r.first()["_main_text"] == 7 and r.first()["__main_text"].startswith("Title")
