"""Brute-force stages over lists of (doc_id, text), for the pipeline's test."""

from collections import defaultdict

from test_op3_line_dedup import fold
from test_op9_jaccard import shingles
from test_op10_fm import brute as leaks


def line_deduped(rows):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(k := fold(line)) >= 20:
                holders[k].add(d)
    return [(d, "\n".join(x for x in t.split("\n") if len(holders.get(fold(x), ())) < 3 or max(holders[fold(x)]) == d)) for d, t in rows]


def near_deduped(rows):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d, _ in rows}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return [(d, t) for d, t in rows if label[d] == d]


def decontaminated(rows, bench):
    out = []
    for d, t in rows:
        n, hit, _ = leaks(t, bench)
        if not (hit > 0 and 20 * hit >= n):
            out.append((d, t))
    return out


