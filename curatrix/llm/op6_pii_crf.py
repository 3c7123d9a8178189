"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns of the contract give base spans, and these always stay. A CRF with begin/inside labels
for each kind adds spans that the patterns miss (numbers without a country code, other separators,
spelled-out addresses). Its features are word shapes, digit and dot counts, a few cue words and the
shapes beside a token. It is trained by full-batch gradient ascent on a labelled table of some
hundred sentences made here, and decoded by Viterbi over numpy batches of lines. An added span must
hold what its kind demands (digits, Luhn sum, parts up to 255) and overlap no base span.

Every span must hold a digit, an `@`, or `at` with a dot inside a word or spelled out. A line that
holds no digit, no `@`, no `.` before a letter and not the letters `dot` can't hold one that stays,
so it is not decoded; all other lines of the whole text are.

Long texts cost linear time and bounded memory: the patterns of the contract are matched without
looking at any place more than a few times, and a line of more than PIECE tokens is decoded in pieces
of that many, each with CONTEXT tokens more on both sides, whose labels come from the pieces they
belong to. What the model remembers of tokens is bounded, too.

Defined results
- a null or empty text has no spans; rows that repeat get the same spans; an empty table gives none;
- offsets count code points, ends are exclusive; an added address has 320 characters at most;
- columns of the input are carried along by place, whatever their names; the findings come in one
  struct, named `_pii` or with underscores before that if the name is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, free_name, table

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}

#: The patterns of the contract. As they are written they try a run of digits or letters again
#: from each of its places; in the forms that follow each run is tried once, with the same matches.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(PATTERNS["phone"])


def _emails(text: str):
    """Matches of the email pattern: from each @ outwards, as no part of an address but its @ is one."""
    end = 0
    at = text.find("@")
    while at >= 0:
        local = text[end:at]
        start = end + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def matches(kind: str, text: str):
    """(start, end) of every match of a kind's pattern, leftmost and non-overlapping."""
    if kind == "email":
        yield from _emails(text)
    else:
        for m in {"ip": _IP, "card": _CARD, "phone": _PHONE}[kind].finditer(text):
            yield m.span()


#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "phone": "+"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    if kind == "card":
        return 14 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping for each kind; failing matches go, without another try."""
    out = []
    digits = _DIGIT.search(text) is not None
    for kind in KINDS:
        if _NEEDS[kind] in text if kind in _NEEDS else digits:
            out += [(a, z, kind) for a, z in matches(kind, text) if valid(kind, text[a:z])]
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]], s[1]))


_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_SIGN = re.compile(r"[0-9@]|\.[^\W\d_]|[dD][oO][tT]")
_EDGE = ".,;:!?()[]{}<>\"'|*#%&$-"
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
K = len(LABELS)

#: Words that announce a kind or spell out an address.
CUES = ("mail", "email", "e-mail", "contact", "write", "at", "dot", "com", "org", "net", "ip", "host", "server", "address", "card", "visa", "pay", "phone", "call", "tel", "mobile", "fax", "version", "order", "invoice", "isbn")


# --- features ------------------------------------------------------------------------------------


def shape(token: str) -> str:
    """Runs of letters, digits and signs: `ann.7@x1.org` gives `a.0@a0.a`."""
    s = re.sub(r"[^\W\d_]+", "a", token)
    s = re.sub(r"[0-9]+", "0", s)
    return re.sub(r"(.)\1+", r"\1", s)[:12]


def plain(token: str) -> bool:
    """Without any sign that a span needs."""
    return _SIGN.search(token) is None


def own_features(token: str) -> list[str]:
    """Features of a token by itself; a plain one that is no cue has the bias alone."""
    core = token.strip(_EDGE)
    out = ["bias"]
    low = core.lower()
    if low in CUES:
        out.append(f"cue={low}")
    if plain(token):
        return out
    n = sum("0" <= c <= "9" for c in token)
    out += [f"shape={shape(core)}", f"digits={min(n, 20)}", f"dots={min(core.count('.'), 4)}", f"first={token[0] if not token[0].isalnum() else 'x'}", "rich"]
    if n and n == len(core):
        out.append(f"number={min(n, 20)}")
    if n and not re.search(r"[^\W\d_]", core):
        parts = re.split(r"[^0-9]+", core)
        out.append("groups=" + "-".join(str(len(p)) for p in parts[:6]))
    if "@" in token:
        out.append("at")
    return out


def beside(token: str | None, side: str) -> list[str]:
    if token is None:
        return [f"{side}=none"]
    core = token.strip(_EDGE).lower()
    if core in CUES:
        return [f"{side}={core}"]
    return [] if plain(token) else [f"{side}:{shape(token.strip(_EDGE))}"]


# --- the labelled table --------------------------------------------------------------------------


def labelled_table(n: int = 700, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Made sentences with a label for each token: every kind in many spellings, and look-alikes outside."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[int(r.integers(len(x)))]
    num = lambda k: "".join(str(int(r.integers(10))) for _ in range(k))
    word = lambda: "".join(pick(*"abcdefghilmnoprstuv") for _ in range(int(r.integers(2, 9))))

    def filler() -> str:
        w = pick(word(), word(), word(), word(), "at", "on", "the", "call", "write", "card", "com")
        return pick(w, w, w.capitalize(), w + ",", w + ".", w.upper())

    def entity(kind: str) -> str:
        if kind == "email":
            a, d = word() + pick("", num(2), "." + word()), word() + pick("", num(1))
            t = pick("com", "org", "net")
            return pick(f"{a}@{d}.{t}", f"{a}@{d}.example.{t}", f"{a} @ {d}.{t}", f"{a} at {d} dot {t}", f"{a} at {d}.{t}", f"{a} [at] {d} [dot] {t}", f"{a}(at){d}(dot){t}", f"{a} at {d} dot example dot {t}")
        if kind == "ip":
            p = [str(int(r.integers(256))) for _ in range(4)]
            return pick(".".join(p), ".".join(p), "[.]".join(p), " . ".join(p))
        if kind == "card":
            d = num(16)
            g = [d[i : i + 4] for i in range(0, 16, 4)]
            return pick(d, " ".join(g), "-".join(g), ".".join(g), "/".join(g), "4" + num(12), d + num(3))
        a, b, c = num(3), num(3), num(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{num(2)} {a} {b} {c}", f"+{num(2)} {a} {b} {c}", f"{a} {b} {c}")

    def other() -> str:
        y = str(int(r.integers(1900, 2100)))
        return pick(y, num(1), num(2), num(5), num(7), f"{num(1)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"{y}-0{pick(*'123456789')}-{num(2)}", f"#{num(6)}", f"${num(3)}.{num(2)}", f"{word()}{num(3)}", f"{num(2)}%", f"{num(3)},{num(3)}", f"{num(2)}:{num(2)}", f"@{word()}", num(24), "dots", "anecdote")

    cue = {"email": ("mail", "contact", "write"), "ip": ("host", "ip", "server"), "card": ("card", "visa", "pay"), "phone": ("call", "tel", "phone")}
    out = []
    for i in range(n):
        tokens, labels = [], []
        for _ in range(int(r.integers(1, 4))):
            for _ in range(int(r.integers(0, 6))):
                tokens.append(filler())
                labels.append("O")
            if r.random() < 0.35:
                for t in other().split():
                    tokens.append(t)
                    labels.append("O")
            else:
                kind = KINDS[(i + int(r.integers(4))) % 4]
                if r.random() < 0.4:
                    tokens.append(pick(*cue[kind]))
                    labels.append("O")
                parts = entity(kind).split()
                parts[-1] += pick("", "", "", ",", ".")
                tokens += parts
                labels += [f"{'I' if j else 'B'}-{kind}" for j in range(len(parts))]
            tokens.append(filler())
            labels.append("O")
        out.append((tokens, labels))
    return out


# --- the model -----------------------------------------------------------------------------------


@dataclass
class Crf:
    index: dict[str, int]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # from label, to label
    first: np.ndarray

    def rows(self, tokens: list[str], cache: dict | None = None) -> list[list[int]]:
        """Known feature numbers of each token in its sentence."""
        cache = {} if cache is None else cache
        sides = {"before": {}, "after": {}}
        for side in sides:
            sides[side] = cache.setdefault(side, {})
        own = cache.setdefault("own", {})
        get = self.index.get

        def known(store, token, make):
            got = store.get(token)
            if got is None:
                got = [j for f in make(token) if (j := get(f)) is not None]
                if token is None or len(token) <= 64:
                    store[token] = got
                if len(store) > 100_000:
                    store.clear()
            return got

        out = []
        for i, t in enumerate(tokens):
            prev, nxt = tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None
            out.append(known(own, t, own_features) + known(sides["before"], prev, lambda x: beside(x, "before")) + known(sides["after"], nxt, lambda x: beside(x, "after")))
        return out

    def decode(self, sentences: list[list[str]], cache: dict | None = None) -> list[np.ndarray]:
        """Best label paths, by Viterbi over all sentences of a batch at once, the longest first."""
        if not sentences:
            return []
        order = sorted(range(len(sentences)), key=lambda i: -len(sentences[i]))
        flat = [row for i in order for row in self.rows(sentences[i], cache)]
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        idx = np.fromiter((j for row in flat for j in row), np.int64, int(size.sum()))
        score = np.add.reduceat(np.vstack([self.weights[idx], np.zeros((1, K))]), np.minimum(np.cumsum(size) - size, len(idx)), axis=0)
        score[size == 0] = 0
        length = np.array([len(sentences[i]) for i in order])
        at = np.cumsum(length) - length
        best = score[at] + self.first
        back = np.zeros((len(flat), K), np.int8)
        for t in range(1, int(length[0])):
            n = int(np.searchsorted(-length, -t))  # sentences with more than t tokens
            via = best[:n, :, None] + self.moves[None]
            back[at[:n] + t] = via.argmax(1)
            best[:n] = via.max(1) + score[at[:n] + t]
        label = np.zeros(len(flat), np.int8)
        now = best.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            n = int(np.searchsorted(-length, -t))
            label[at[:n] + t] = now[:n]
            if t:
                now[:n] = back[at[:n] + t, now[:n]]
        out: list[np.ndarray] = [None] * len(order)
        for k, i in enumerate(order):
            out[i] = label[at[k] : at[k] + length[k]]
        return out


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with a quadratic penalty: forward-backward in numpy over the whole table each round."""
    index: dict[str, int] = {}
    feats = []
    for tokens, _ in rows:
        sent = []
        for i, t in enumerate(tokens):
            f = own_features(t) + beside(tokens[i - 1] if i else None, "before") + beside(tokens[i + 1] if i + 1 < len(tokens) else None, "after")
            sent.append([index.setdefault(x, len(index)) for x in f])
        feats.append(sent)
    n, longest = len(rows), max(len(t) for t, _ in rows)
    length = np.array([len(t) for t, _ in rows])
    tok, who, when = [], [], []
    gold = np.zeros((n, longest), np.int64)
    for i, (sent, (_, labels)) in enumerate(zip(feats, rows, strict=True)):
        for t, f in enumerate(sent):
            tok += f
            who += [i] * len(f)
            when += [t] * len(f)
            gold[i, t] = LABELS.index(labels[t])
    tok, who, when = map(np.array, (tok, who, when))
    live = np.arange(longest)[None] < length[:, None]
    w, moves, first = np.zeros((len(index), K)), np.zeros((K, K)), np.zeros(K)
    hot = np.eye(K)[gold] * live[..., None]
    pair = live[:, 1:]
    gold_moves = np.einsum("nti,ntj->ij", hot[:, :-1] * pair[..., None], hot[:, 1:])
    # Inside never follows anything but begin or inside of its kind.
    closed = np.zeros((K, K))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:] or a == "O":
                    closed[i, j] = -30.0
    shut = np.array([-30.0 if x[0] == "I" else 0.0 for x in LABELS])
    seen = [np.zeros_like(x) for x in (w, moves, first)]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for _ in range(rounds):
        e = np.zeros((n, longest, K))
        np.add.at(e, (who, when), w[tok])
        a, b = np.zeros((n, longest, K)), np.zeros((n, longest, K))
        m = moves + closed
        a[:, 0] = first + shut + e[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(live[:, t, None], lse(a[:, t - 1, :, None] + m, 1) + e[:, t], a[:, t - 1])
        z = lse(a[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], lse(m[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0.0)
        p = np.exp(a + b - z[:, None, None]) * live[..., None]
        q = np.exp(a[:, :-1, :, None] + m + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[..., None, None]
        gw = np.zeros_like(w)
        np.add.at(gw, tok, (hot - p)[who, when])
        grads = (gw / n - decay * w, (gold_moves - q.sum((0, 1))) / n - decay * moves, (hot[:, 0] - p[:, 0]).sum(0) / n - decay * first)
        for x, g, s in zip((w, moves, first), grads, seen, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s + 1e-8)
    return Crf(index, w, moves + closed, first + shut)


_MODEL: dict[str, Crf] = {}


def default_model() -> Crf:
    """The model of the labelled table; trained once a process, in a few seconds."""
    if "crf" not in _MODEL:
        _MODEL["crf"] = train(labelled_table())
    return _MODEL["crf"]


# --- spans ---------------------------------------------------------------------------------------

_SPELLED = re.compile(r"[^\s@]+(?:\s*@\s*|\s+at\s+|\s*[(\[]at[)\]]\s*)[^\s@.()\[\]]+(?:(?:\.|\s+dot\s+|\s*[(\[]dot[)\]]\s*)[^\s@.()\[\]]+)+", re.I)
_ADDRESS = 320
PIECE, CONTEXT, BATCH_TOKENS = 4096, 32, 1 << 16


def sign_lines(text: str):
    """Bounds of the lines that hold what a span needs."""
    at = 0
    while (m := _SIGN.search(text, at)) is not None:
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield text.rfind("\n", 0, m.start()) + 1, end
        at = end + 1


def _holds(kind: str, s: str) -> bool:
    """What an added span must hold."""
    if kind == "email":
        return len(s) <= _ADDRESS and _SPELLED.fullmatch(s) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and max(map(len, parts)) <= 3 and all(int(p) <= 255 for p in parts) and not re.search(r"[^\W\d_]", s)
    if re.search(r"[^\W\d_]", s):
        return False
    return valid(kind, s)


def line_pieces(text: str, a: int, z: int):
    """(tokens, starts, lo, hi, last) of a line's pieces: lo to hi are the tokens whose labels the piece gives."""
    found = _TOKEN.finditer(text, a, z)
    held = [(m[0], m.start()) for m in islice(found, PIECE + CONTEXT)]
    lo = 0
    while held:
        hi = min(lo + PIECE, len(held))
        more = [(m[0], m.start()) for m in islice(found, PIECE)] if hi < len(held) or len(held) == lo + PIECE + CONTEXT else []
        last = hi == len(held) and not more
        yield [t for t, _ in held], [s for _, s in held], lo, hi, last
        if last:
            return
        held = held[max(0, hi - CONTEXT) :] + more
        lo = min(hi, CONTEXT)


def free_of(spans: list[tuple[int, int, str]]):
    """Whether a stretch overlaps none of the spans."""
    starts, ends = [], []
    for a, z, _ in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)

    def free(a: int, z: int) -> bool:
        i = bisect_left(ends, a + 1)
        return i == len(ends) or starts[i] >= z

    return free


def added_spans(crf: Crf, texts: list[str], base: list[list], cache: dict) -> list[list[tuple[int, int, str]]]:
    """Spans of the CRF for each text, clear of its base spans."""
    out: list[list] = [[] for _ in texts]
    free: dict[int, object] = {}
    held: list[tuple] = []
    line: list[tuple] = []  # labelled tokens of the line that is open, from its first token that begins or continues a span

    def take(i: int, spans: list[tuple]):
        """Adds the spans of labelled tokens (start, end, label) in a row."""
        text, k = texts[i], 0
        while k < len(spans):
            kind, j = KINDS[(spans[k][2] - 1) // 2], k + 1
            while j < len(spans) and spans[j][2] % 2 == 0 and KINDS[(spans[j][2] - 1) // 2] == kind:
                j += 1
            a, z = spans[k][0], spans[j - 1][1]
            while a < z and text[a] in _EDGE and text[a] != "(":
                a += 1
            while z > a and text[z - 1] in _EDGE:
                z -= 1
            if a < z and _holds(kind, text[a:z]):
                if i not in free:
                    free[i] = free_of(base[i])
                if free[i](a, z):
                    out[i].append((a, z, kind))
            k = j

    def flush():
        for (i, tokens, starts, lo, hi, last), path in zip(held, crf.decode([h[1] for h in held], cache), strict=True):
            at = lo
            for k in np.flatnonzero(path[lo:hi]).tolist():
                k += lo
                if k > at and line:  # tokens outside any span lie between
                    take(i, line)
                    line.clear()
                line.append((starts[k], starts[k] + len(tokens[k]), int(path[k])))
                at = k + 1
            if line and (last or at < hi):
                take(i, line)
                line.clear()
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        for a, z in sign_lines(t) if t else ():
            for piece in line_pieces(t, a, z):
                held.append((i, *piece))
                size += len(piece[0])
                if size >= BATCH_TOKENS:
                    flush()
                    size = 0
    flush()
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_FOUND = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])


def find_pii(docs: DataFrame, *, text: str = "text", out: str = "_pii", model: Crf | None = None) -> DataFrame:
    """docs with a struct (named out, or with underscores before it): base spans counted by kind, base spans and all spans as `kind:start:end` lists."""
    # A few hundred features by nine labels, whatever the data.
    cast = docs.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf(_FOUND)
    def scan(texts):
        import pandas as pd

        crf, cache, rows = cast.value, {}, []
        for at in range(0, len(texts), 512):
            part = [t or "" for t in texts.iloc[at : at + 512]]
            base = [base_spans(t) for t in part]
            for b, a in zip(base, added_spans(crf, part, base, cache), strict=True):
                n = [sum(k == kind for _, _, k in b) for kind in KINDS]
                rows.append((*n, _joined(b), _joined(sorted(b + a, key=lambda s: (s[0], _RANK[s[2]], s[1])) if a else b)))
        return pd.DataFrame(rows, columns=_FOUND.names)

    flat, at = by_place(docs)
    return flat.select("*", scan(F.col(at[text]))).toDF(*docs.columns, free_name(docs, out))


def redact_text(text: str, spans: str) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first stands."""
    parts, at = [], 0
    for s in spans.split(",") if spans else ():
        kind, a, z = s.split(":")
        if int(a) >= at:
            parts += [text[at : int(a)], f"[{kind.upper()}]"]
            at = int(z)
    return "".join(parts) + text[at:]


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base counts, the digest of the base spans, and all spans of every document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("_pii").alias("p"))
    n_spans = F.when(F.col("p.spans") != "", F.size(F.split("p.spans", ","))).otherwise(0).cast("bigint")
    counts = (F.col(f"p.n_{k}").alias(f"n_{k}") for k in KINDS)
    return found.select("doc_id", *counts, F.sha2(F.encode("p.base", "UTF-8"), 256).alias("base_sha256"), F.col("p.spans").alias("spans"), n_spans.alias("n_spans"))
