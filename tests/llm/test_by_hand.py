"""Operators 6 and 7 on sentences and pages written by hand, of which their generators and models know nothing.

`pii_sentences.txt` marks spans as {{kind|text}}; 55 of its 110 sentences hold none. `pages_by_hand.txt` holds
pages and their main texts. Line breaks within a block count as white space, as everywhere in operator 7.
"""

import re
from collections import Counter
from pathlib import Path

from curatrix.llm import op6_pii_crf, op7_html_main

HERE = Path(__file__).parent


def sentences():
    for line in (HERE / "pii_sentences.txt").read_text("utf-8").splitlines():
        text, spans, at = "", set(), 0
        for m in re.finditer(r"\{\{(\w+)\|(.*?)\}\}", line):
            text += line[at : m.start()]
            spans.add((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        yield text + line[at:], spans


def test_personal_data_by_hand():
    rows = list(sentences())
    texts = [t for t, _ in rows]
    base = [op6_pii_crf.base_spans(t) for t in texts]
    added = op6_pii_crf.added_spans(op6_pii_crf.default_model(), texts, base, {})
    n = Counter()
    for (_, want), b, a in zip(rows, base, added, strict=True):
        n["want"] += len(want)
        n["base right"] += len(want & set(b))
        n["base"] += len(b)
        n["added right"] += len(want & set(a) - set(b))
        n["added"] += len(set(a) - set(b))
    print(dict(n))
    assert len(rows) >= 100 and n["want"] >= 60
    # The model must find most of what the patterns don't, and nearly nothing else.
    assert n["added right"] >= 0.8 * (n["want"] - n["base right"]) and n["added right"] >= 0.9 * n["added"]
    assert n["base right"] + n["added right"] >= 0.9 * n["want"]


def test_main_text_by_hand():
    cases = [[x.strip("\n") for x in c.split("\n==")] for c in (HERE / "pages_by_hand.txt").read_text("utf-8").split("%%\n")]
    got = op7_html_main.extract_batch([h for h, _ in cases], op7_html_main.default_model())
    chars = lambda c: sum(len(k) * v for k, v in c.items())
    right = found = want = exact = 0
    for (_, w), g in zip(cases, got, strict=True):
        a, b = Counter(w.split("\n")), Counter(g.split("\n"))
        right, found, want, exact = right + chars(a & b), found + chars(b), want + chars(a), exact + (w == g)
    print(len(cases), exact, right / found, right / want)
    assert len(cases) >= 40 and exact >= 0.8 * len(cases) and right >= 0.95 * found and right >= 0.95 * want
