"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

The pieces of a SentencePiece model span a lattice over each text. Forward filtering sums the weight
of all paths to every position; backward sampling then draws pieces from the end, each with its
exact conditional probability, so a segmentation is drawn in proportion to the product of its
pieces' probabilities to the power ALPHA. The random number of a draw is a hash of the seed, the
row's key and the position in the text: results don't depend on partitions, batches or retries.

No piece crosses from a non-space to a space or over a line break, so the lattice falls apart there;
equal segments share one lattice in a batch, and all draws of a batch take a few numpy passes. A text
of more than CHUNK_CHARS is taken in parts that end where segments do, and a segment of more than
LONG_CHARS (a run without spaces) is filtered block by block, keeping only the weights at the borders
of blocks, and sampled backwards over blocks that are filtered again. So memory is bounded for a text
of any length, and draws stay what they are, as they depend on key and position alone.
The given vocabulary is a merge list whose scores are ranks; its pieces get Zipf weights, the
probability 1 / (rank + 2) normalised. A model with log probabilities can use them as they are.

Encoding is lossless: a space is put first, spaces are the model's space mark, and every other
character outside the vocabulary (the mark itself included) goes to byte pieces.

Defined results
- a null text has null pieces and decodes to null; an empty one has none and decodes to empty;
- rows that share key and text get the same pieces; a null key is a key like others;
- an empty table gives an empty result; all columns are carried along, the pieces in one new column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, free_name, mix64, table

ALPHA = 1.0
SEED = 20240501
CHUNK_CHARS = 700_000
LONG_CHARS, BLOCK = 100_000, 1 << 16

_SEGMENT = re.compile(r"\n| *[^ \n]+| +")


@dataclass
class Vocabulary:
    """Pieces with their ids and log weights; byte_id[b] is the piece of byte b."""

    pieces: dict[str, int]
    logp: np.ndarray
    byte_id: np.ndarray
    as_bytes: list[bytes]
    tables: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"tables": {}}


def load_vocabulary(path: str, scores: str = "zipf", alpha: float = ALPHA) -> Vocabulary:
    """Reads a SentencePiece model on the driver; scores is `zipf` (by rank) or `model` (its log probabilities)."""
    import sentencepiece

    with open(path, "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    n = sp.get_piece_size()
    pieces, as_bytes, byte_id, logp = {}, [b""] * n, np.zeros(256, np.int32), np.zeros(n)
    ranks = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i))]
    for rank, i in enumerate(ranks):
        p = sp.id_to_piece(i)
        logp[i] = -np.log(rank + 2.0) if scores == "zipf" else sp.get_score(i)
        if sp.is_byte(i):
            b = int(p[3:5], 16)
            byte_id[b], as_bytes[i] = i, bytes([b])
        else:
            text = p.replace("▁", " ")
            if re.search(r"[^ ] |\n", text):
                raise ValueError(f"piece {p!r} crosses a segment's border")
            pieces[text], as_bytes[i] = i, text.encode()
    used = np.array(ranks)
    if max(map(len, pieces)) > _LONGEST:
        raise ValueError(f"a piece has more than {_LONGEST} characters")
    if scores == "zipf":
        # Byte pieces stand for what no piece covers: they rank after all others.
        logp[byte_id] = -np.log(len(ranks) + 2.0)
        logp[used] -= np.log(np.exp(logp[used]).sum())
    return Vocabulary(pieces, logp * alpha, byte_id, as_bytes)


_K = np.uint64(0x9E3779B97F4A7C15)
_FILTER = np.uint64(64 - 17)
#: The log weight that a character is given back, and the characters of the longest piece.
_SCALE, _LONGEST = 4.0, 16
_MARK, _NEVER = "\n", np.uint64(0x5851F42D4C957F2D)


def _tables(v: Vocabulary) -> dict:
    """For each length: sorted hashes of the pieces, their ids, and a filter over the high bits."""
    if not v.tables:
        by_len: dict[int, list[tuple[str, int]]] = {}
        for p, i in v.pieces.items():
            by_len.setdefault(len(p), []).append((p, i))
        for size, items in by_len.items():
            codes = np.frombuffer("".join(p for p, _ in items).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)
            h = np.zeros(len(items), np.uint64)
            for k in range(size):
                h = (h + codes[:, k] + np.uint64(1)) * _K
            order = np.argsort(h)
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces of a length share a hash")
            seen = np.zeros(1 << (64 - int(_FILTER)), bool)
            seen[h >> _FILTER] = True
            v.tables[size] = (h[order], np.array([i for _, i in items], np.int32)[order], seen)
    return v.tables


def _edges(code: np.ndarray, wide: np.ndarray, ends, longest: int, v: Vocabulary) -> list[tuple]:
    """(starts, length, ids, log weights) of the pieces found in a row of characters: bytes, then by falling length.

    ends are places that are no characters; ids of characters that take byte pieces are -1 - code point.
    """
    found, single = [], np.zeros(len(code), bool)
    tables = _tables(v)
    h = wide * _K
    for length in range(1, min(max(tables), longest) + 1):
        if length > 1:
            h = h[:-1] + wide[length - 1 :]
            h *= _K
        if length in tables:
            keys, piece, seen = tables[length]
            at = np.flatnonzero(seen[(h >> _FILTER).view(np.int64)])
            m = h[at]
            where = np.minimum(np.searchsorted(keys, m), len(keys) - 1)
            ok = keys[where] == m
            at, p = at[ok].astype(np.int32), piece[where[ok]]
            if length == 1:
                single[at] = True
            found.append((at, length, p, v.logp[p]))
    single[ends] = True
    rest = np.flatnonzero(~single).astype(np.int32)
    cp = code[rest].astype(np.int32)
    n_bytes = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    found.append((rest, 1, -1 - cp, n_bytes * v.logp[v.byte_id[0]]))
    return found[::-1]


class Lattice:
    """All lattices of some distinct segments, laid out one after the other.

    Longer segments come first. Each takes its characters and one place more, so that place p is the
    node before character p, and the extra place the segment's end; the mark that stands there is in
    no piece, so windows over the whole row of characters never match across segments.
    """

    def __init__(self, segments: list[str], v: Vocabulary):
        n = len(segments)
        size = np.fromiter(map(len, segments), np.int64, n)
        order = np.argsort(-size, kind="stable")
        longest = int(size[order[0]])
        base = np.cumsum(size[order] + 1) - size[order] - 1
        text = _MARK.join([segments[i] for i in order.tolist()]) + _MARK
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = base + size[order]
        wide = code.astype(np.uint64) + np.uint64(1)
        wide[ends] = _NEVER
        self.size, self.base, self.longest = size, base, longest
        self.end = np.empty(n, np.int64)
        self.end[order] = ends
        self.offset = np.arange(len(code)) - np.repeat(base, size[order] + 1)
        self.count = n - np.cumsum(np.bincount(size, minlength=longest + 1))  # segments with more than d characters
        self._filter(_edges(code, wide, ends, longest, v))

    def _filter(self, found):
        """Weights of all paths to each node, then each edge's share of its node's.

        found: (starts, length, ids, log weights) by length, the longest first, so that a node's
        likeliest piece is mostly its first. No two edges of one length share an end.
        """
        width = np.zeros(len(self.offset), np.int32)
        for start, length, _, _ in found:
            width[start + length] += 1
        head = np.cumsum(width, dtype=np.int32) - width
        total = int(width.sum())
        starts, ids, weight = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        free = head.copy()
        for start, length, i, w in found:
            end = start + length
            at = free[end]
            free[end] = at + 1
            # A weight of about 1 for each character keeps the sums near 1; they are scaled on the way.
            starts[at], ids[at], weight[at] = start, i, np.exp(w + _SCALE * length)
        alpha = np.ones(len(width))
        share = np.empty(total)
        ramp = np.arange(total, dtype=np.int32)
        for d in range(1, self.longest + 1):
            node = self.base[: self.count[d - 1]] + d
            k = width[node]
            first = np.cumsum(k, dtype=np.int32) - k
            edge = ramp[: int(first[-1] + k[-1])] + np.repeat(head[node] - first, k)
            x = weight[edge] * alpha[starts[edge]]
            sums = np.add.reduceat(x, first)
            share[edge] = x / np.repeat(sums, k)
            alpha[node] = sums
            if d % _LONGEST == 0 and self.count[d]:
                node = self.base[: self.count[d]] + d
                scale = 1.0 / alpha[node]
                for back in range(_LONGEST):
                    alpha[node - back] *= scale
        share = np.cumsum(share)
        last = (head + width)[width > 0] - 1
        share -= np.repeat(np.concatenate(([0.0], share[last[:-1]])), width[width > 0])
        share[last] = 2.0
        self.within, self.start, self.ids, self.head = share, starts, ids, head

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An incoming edge of each node, by its conditional probability."""
        edge = self.head[node]
        on = np.flatnonzero(u >= self.within[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] >= self.within[edge[on]]]
        return edge


def _uniform(key: np.ndarray, position: np.ndarray) -> np.ndarray:
    x = mix64(key + position.astype(np.uint64) * _K)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class LongSegment:
    """The lattice of one long segment, a block of nodes at a time."""

    def __init__(self, text: str, v: Vocabulary, block: int):
        self.text, self.v, self.block = text, v, max(block, _LONGEST)
        self.borders: list[list[float]] = [[1.0]]  # weights of the last nodes up to each block's first border
        for b in range(-(-len(text) // self.block)):
            weights = self._filtered(b)[0]
            self.borders.append(weights[-_LONGEST:])

    def _filtered(self, b: int):
        """(weights of the nodes from the carried ones on, first node, head, starts, ids, path weights of edges) of a block."""
        a, z = b * self.block, min((b + 1) * self.block, len(self.text))
        alpha = list(self.borders[b])
        lo = a + 1 - len(alpha)
        code = np.frombuffer(self.text[lo:z].encode("utf-32-le", "surrogatepass"), np.uint32)
        found = _edges(code, code.astype(np.uint64) + np.uint64(1), np.empty(0, np.int64), len(code), self.v)
        end = np.concatenate([s + n for s, n, _, _ in found])
        use = np.flatnonzero(end > a - lo)
        use = use[np.argsort(end[use], kind="stable")]
        starts = np.concatenate([s for s, *_ in found])[use].tolist()
        ids = np.concatenate([i for _, _, i, _ in found])[use].tolist()
        weight = np.exp(np.concatenate([w + _SCALE * n for _, n, _, w in found])[use]).tolist()
        head = np.searchsorted(end[use], np.arange(a + 1 - lo, z + 2 - lo)).tolist()
        for k in range(len(head) - 1):
            total = 0.0
            for e in range(head[k], head[k + 1]):
                # From here on the weight of all paths that end with this piece, in the scale of its node.
                weight[e] *= alpha[starts[e]]
                total += weight[e]
            alpha.append(total)
            if not 1e-100 < total < 1e100:
                scale = 1.0 / total
                alpha[-_LONGEST:] = [x * scale for x in alpha[-_LONGEST:]]
        return alpha, lo, head, starts, ids, weight

    def draw(self, key: np.uint64, before: int) -> list[int]:
        """Sampled ids; before is the segment's place in the text."""
        node, out = len(self.text), []
        for b in reversed(range(len(self.borders) - 1)):
            a = b * self.block
            if node <= a:
                continue
            _, lo, head, starts, ids, weight = self._filtered(b)
            u = _uniform(np.full(node - a, key), np.arange(a + 1, node + 1) + before).tolist()
            while node > a:
                k = node - a - 1
                left = u[k] * sum(weight[head[k] : head[k + 1]])
                for e in range(head[k], head[k + 1]):
                    left -= weight[e]
                    if left < 0:
                        break
                out.append(ids[e])
                node = starts[e] + lo
        return out[::-1]


def parts(text: str, most: int = CHUNK_CHARS, long: int = LONG_CHARS):
    """(place, part) of a text, space included: parts end where segments do, and hold one long segment or none."""
    if len(text) <= most and len(text) <= long:
        yield 0, text
        return
    a = z = 0
    for m in _SEGMENT.finditer(text):
        if m.end() - m.start() > long:
            if m.start() > a:
                yield a, text[a : m.start()]
            yield m.start(), m[0]
            a = m.end()
        elif m.end() - a >= most:
            yield a, text[a : m.end()]
            a = m.end()
        z = m.end()
    if z > a:
        yield a, text[a:z]


def encode_batch(texts: list[str], keys: np.ndarray, v: Vocabulary, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts in a row, and how many each text has."""
    key = mix64(keys.view(np.uint64) + np.uint64(seed))
    ids, owners, held, size = [], [], [], 0

    def flush():
        nonlocal size
        if held:
            of, base, some = zip(*held, strict=True)
            of = np.array(of)
            got, n = _encode_parts(list(some), key[of], np.array(base, np.int64), v)
            ids.append(got)
            owners.append(np.repeat(of, n))
        held.clear()
        size = 0

    for i, t in enumerate(texts):
        for at, part in parts(" " + t) if t else ():
            if len(part) > LONG_CHARS and _SEGMENT.fullmatch(part):
                flush()
                drawn = np.array(LongSegment(part, v, BLOCK).draw(key[i], at), np.int64)
                got, owner = _bytes(drawn, np.full(len(drawn), i), v)
                ids.append(got.astype(np.int32))
                owners.append(owner)
                continue
            held.append((i, at, part))
            size += len(part)
            if size >= CHUNK_CHARS:
                flush()
    flush()
    if not ids:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    return np.concatenate(ids), np.bincount(np.concatenate(owners), minlength=len(texts))


def _encode_parts(texts: list[str], keys: np.ndarray, base: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of parts that stand at base in texts with those mixed keys."""
    names: dict[str, int] = {}
    occ, per_doc = [], []
    for t in texts:
        found = _SEGMENT.findall(t)
        per_doc.append(len(found))
        occ.extend([names.setdefault(s, len(names)) for s in found])
    per_doc = np.array(per_doc, np.int64)
    occ = np.array(occ, np.int64)
    lat = Lattice(list(names), v)
    length = lat.size[occ]
    doc = np.repeat(np.arange(len(texts)), per_doc)
    before = np.cumsum(length) - length
    doc_first = np.concatenate(([0], np.cumsum(per_doc)))[:-1]
    before += (base - before[doc_first])[doc]
    key = keys[doc]
    node, active, steps = lat.end[occ], np.arange(len(occ)), []
    count = np.zeros(len(occ), np.int64)
    while len(active):
        n = node if len(active) == len(node) else node[active]
        edge = lat.draw(n, _uniform(key[active], before[active] + lat.offset[n]))
        steps.append((active, lat.ids[edge]))
        count[active] += 1
        n = lat.start[edge]
        node[active] = n
        active = active[lat.offset[n] > 0]
    last = np.cumsum(count) - 1
    out = np.empty(int(count.sum()), np.int64)
    for k, (a, ids) in enumerate(steps):
        out[last[a] - k] = ids
    owner = np.repeat(doc, count)
    if (out < 0).any():
        out, owner = _bytes(out, owner, v)
    return out.astype(np.int32), np.bincount(owner, minlength=len(texts))


def _bytes(out: np.ndarray, owner: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Puts the byte pieces of UTF-8 in the place of marked code points."""
    cp = np.where(out < 0, -1 - out, 0)
    n = np.where(out < 0, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 1)
    at = np.cumsum(n) - n
    wide = np.repeat(out, n)
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0])
    for i in range(4):
        has = np.flatnonzero((out < 0) & (n > i))
        c, k = cp[has], n[has]
        low = (c >> (6 * (k - 1 - i))) & 0x3F | 0x80
        byte = np.where(k == 1, c, low) if i else np.where(k == 1, c, lead[k] | (c >> (6 * (k - 1))))
        wide[at[has] + i] = v.byte_id[byte]
    return wide, np.repeat(owner, n)


def decode_ids(ids, v: Vocabulary) -> str:
    """The text of piece ids, a list or an array of any length."""
    ids = np.asarray(ids, np.int64)
    # In stretches, as a list takes ten times the memory of an array.
    stretch = lambda i: b"".join(map(v.as_bytes.__getitem__, ids[i : i + (1 << 16)].tolist()))
    return b"".join(map(stretch, range(0, len(ids), 1 << 16)))[1:].decode("utf-8", "surrogatepass")


def _encoder(cast, text: str, key: str, seed: int):
    def run(batches):
        v = cast.value
        for b in batches:
            at = 0
            while at < b.num_rows:  # a batch in pieces of bounded text
                size, z = 0, at
                col = b.column(text)
                while z < b.num_rows and (z == at or size < CHUNK_CHARS):
                    x = col[z].as_py() if col[z].is_valid else ""
                    size += len(x)
                    z += 1
                part = b.slice(at, z - at)
                texts = part.column(text).to_pylist()
                ids, n = encode_batch([t or "" for t in texts], part.column(key).to_numpy(zero_copy_only=False).astype(np.int64), v, seed)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                mask = pa.array([t is None for t in texts])
                pieces = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()), mask=mask)
                cols = [c for name, c in zip(part.schema.names, part.columns, strict=True) if name != key]
                names = [name for name in part.schema.names if name != key]
                yield pa.RecordBatch.from_arrays([*cols, pieces], names=[*names, "pieces"])
                at = z

    return run


def encode(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", seed: int = SEED, alpha: float = ALPHA, scores: str = "zipf", out: str = "pieces") -> DataFrame:
    """docs with a column of sampled piece ids (named out, or with underscores before it if that is taken)."""
    spark = docs.sparkSession
    # The vocabulary is a fixed file of some 100 kB, whatever the data.
    cast = spark.sparkContext.broadcast(load_vocabulary(model_path, scores, alpha))
    flat, names = by_place(docs)
    at = names[text]
    keyed = flat.withColumn("_key", F.xxhash64(names[key]))
    schema = T.StructType([*flat.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    return keyed.mapInArrow(_encoder(cast, at, "_key", seed), schema).toDF(*docs.columns, free_name(docs, out))


def decode(pieces: DataFrame, model_path: str, *, column: str = "pieces", out: str = "decoded") -> DataFrame:
    """pieces with a column of the decoded texts (named out, or with underscores before it)."""
    cast = pieces.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    flat, at = by_place(pieces)

    @F.pandas_udf(T.StringType())
    def text(ids):
        import pandas as pd

        v = cast.value
        return pd.Series([None if x is None else decode_ids(x, v) for x in ids], dtype=object)

    return flat.select("*", text(F.col(at[column]))).toDF(*pieces.columns, free_name(pieces, out))


def default_model(name: str = "piece_bpe_32k.model") -> str:
    """The path of an installed public vocabulary; any other model's path can be given to encode() instead."""
    try:
        import public_tokenizers
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError("no vocabulary files are installed: give encode() and decode() the path of a SentencePiece model", name=e.name) from e
    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Sampled pieces of every document, and whether they decode to the text."""
    model = model_path or default_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs, model), model)
    return done.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
