"""Helpers shared by the corpus operators: shared storage, hashing and word splitting."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import remove_tree, shared_dir, staged, write_staged

__all__ = ["remove_tree", "shared_dir", "staged", "write_staged"]

#: The ASCII white space of the contracts, and the letters whose case is folded.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Stands for a null id inside an operator; ids are signed 64-bit integers.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Kept:
    """Tables that only live while an operator runs: on the executors' disks, or in the shared folder.

    What is lost on an executor is made again from the tables before; what is staged survives and cuts
    the lineage. release() gives both back, once the operator's result is written elsewhere.
    """

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist(StorageLevel.DISK_ONLY))
        return self.tables[-1]

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = write_staged(df, name)
        self.paths.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        for df in self.tables:
            df.unpersist()
        for spark, path in self.paths:
            remove_tree(spark, path)
        self.tables, self.paths = [], []


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Smaller Arrow batches for the actions inside: texts are long, so the default number of rows is a lot of memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever case rules apply."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ... by place, and the new name of each: names may clash, repeat or hold dots."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {c: n for c, n in reversed(list(zip(df.columns, names, strict=True)))}


def small_side(df: DataFrame, most_bytes: int = 32 << 20, size: str | None = None) -> DataFrame:
    """df as the side to broadcast if it has been measured to be small, as it is otherwise: a shuffle then joins it.

    The measure is 16 bytes a row and what size, an SQL expression, says of each. df should be cheap to
    read, as it is counted first.
    """
    n = df.agg(F.coalesce(F.sum(F.expr(f"16 + {size or 0}").cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most_bytes else df


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


# --- hashing of words in numpy -------------------------------------------------------------------

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One 64-bit value for each byte, from the mixer; not a table of constants.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_CHUNK = 1 << 20
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = max(n, _CHUNK + 1)
        for name, base in (("p", _P), ("q", _PINV)):
            a = np.full(size, np.uint64(base), dtype=np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["p"], _POW["q"]


def word_hashes(data: bytes, is_space: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each maximal run of bytes b with not is_space[b], in order.

    A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums, so the whole
    text takes a fixed number of numpy passes; the finaliser spreads it over all bits.
    """
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([0], (~is_space[b]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    if len(b) <= _CHUNK:
        return _hash_spans(b, starts, ends)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # a long text in pieces that end between words
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = _hash_spans(b[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def _hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, q = _powers(len(b) + 1)
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=s[1:])
    h = (s[ends] - s[starts]) * q[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def byte_set(member) -> np.ndarray:
    """Which of the 256 byte values member() holds for."""
    return np.array([bool(member(i)) for i in range(256)])


#: Bytes that separate words `[^\x20\x09-\x0D]+`.
SPACE_BYTES = byte_set(lambda i: i == 0x20 or 0x09 <= i <= 0x0D)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every window of n consecutive word hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(_P) + hashes[k : k + m]
    return mix64(out + np.uint64(n))
