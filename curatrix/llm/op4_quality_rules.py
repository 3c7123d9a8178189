"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger stores its measurements and one bit for
each rule that fails. A policy is a versioned bitmask over those rules: applying one, changing one,
or asking what a policy would keep without a rule are bitwise operations on the ledger, with no
second look at any text.

Defined results
- a null or empty text has no words and no lines with a word, and fails `few_words` alone;
- rows that repeat are measured one by one; an empty table gives an empty ledger;
- a text of any length is measured whole, its cost linear in its words;
- columns of the input are carried along by place, whatever their names; the ledger comes in one
  struct, named `_ledger` or with underscores before that if the name is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, free_name, staged, table

#: Fixed values of the contract: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")


@dataclass(frozen=True)
class Rule:
    """fails is SQL over the measurements, in whole numbers."""

    name: str
    fails: str


#: A rule's place is its bit, so rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("shouting", "2 * n_upper > n_letters"),
    Rule("exclamations", "5 * n_bangs > n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}

#: Versioned policies: the rules that a kept document must pass. Ablation over labelled documents showed
#: that `repeated_lines` alone rejects only good ones, so prose-2 leaves it to the ledger.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "prose-1": sum(BIT.values()),
    "prose-2": sum(BIT.values()) - BIT["repeated_lines"],
}
PRODUCTION = "prose-2"


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at ASCII white space alone
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = len(lines) - len(set(lines))
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = upper + len(data) - len(data.translate(None, _LOWER))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated, _repeat_words(words), len(lines), upper, letters, data.count(b"!")


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def _repeat_words(words: list[bytes]) -> int:
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    often = {w for w, k in Counter(windows).items() if k > 1}
    count = until = 0
    for i, w in enumerate(windows):
        if w in often:
            count += i + 3 - max(i, until)
            until = i + 3
    return count


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(text):
    import pandas as pd

    return pd.DataFrame([measure_text(t) for t in text], columns=list(MEASURES), dtype="int64")


def fail_bits(struct: str) -> Column:
    """The failure bits of every rule over a struct column of measurements, by its name."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        failed = F.expr(re.sub(r"[a-z]\w*", rf"{struct}.\g<0>", rule.fails))
        bits = bits.bitwiseOR(F.when(failed, F.lit(BIT[rule.name]).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def ledger(docs: DataFrame, *, text: str = "text", out: str = "_ledger") -> DataFrame:
    """docs with a struct (named out, or with underscores before it) of all measurements and fail_bits."""
    flat, at = by_place(docs)
    # The Python step runs once: its struct is read by name from then on.
    measured = flat.withColumn("m", _measures(F.col(at[text])))
    named = F.col("m").withField("fail_bits", fail_bits("m"))
    return measured.select(*flat.columns, named.alias("m")).toDF(*docs.columns, free_name(docs, out))


def store(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """The ledger as a table of its own, (key, measurements..., fail_bits), written to the shared folder.

    Policies are applied, changed and ablated on this table; no text is read again.
    """
    flat, at = by_place(docs)
    slim = flat.select(F.col(at[key]).alias("_key"), F.col(at[text]).alias("text"))
    led = staged(ledger(slim).select("_key", "_ledger.*"), "quality-ledger")
    return led.toDF(key, *led.columns[1:])


def passes(bits: Column, policy: str = PRODUCTION) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[policy]).cast("bigint")) == 0


def apply_policy(docs: DataFrame, policy: str = PRODUCTION, *, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their columns as they were."""
    flat, at = by_place(docs)
    led = ledger(flat, text=at[text])
    return led.where(passes(F.col("_ledger.fail_bits"), policy)).select(*flat.columns).toDF(*docs.columns)


def ablations(led: DataFrame, policy: str = PRODUCTION, *, bits: str = "_ledger.fail_bits") -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it rejects (kept without it).

    One aggregation over the bits: at most 2^rules patterns are left before anything is counted by rule.
    """
    mask = POLICIES[policy]
    patterns = led.groupBy(F.col(bits).bitwiseAND(F.lit(mask).cast("bigint")).alias("pattern")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("bigint").alias("bit")) for r in RULES if BIT[r.name] & mask]
    each = patterns.select("pattern", "n", F.explode(F.array(*rules)).alias("r")).select("pattern", "n", "r.rule", "r.bit")
    return each.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(F.col("pattern").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("pattern") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only_here"),
        F.coalesce(F.sum(F.when(F.col("pattern") == 0, F.col("n"))), F.lit(0)).alias("n_kept"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the measurements of every document, whether it fails the base rules, and the verdict."""
    led = store(table(spark, sf_dir, "documents"), "doc_id")
    base = ~passes(F.col("fail_bits"), "base")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes(F.col("fail_bits"), PRODUCTION)).alias("kept"), "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every policy and each of its rules: what the rule fails, what it alone rejects, and what the policy keeps."""
    led, out = store(table(spark, sf_dir, "documents"), "doc_id"), None
    for policy in POLICIES:
        one = ablations(led, policy, bits="fail_bits").select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only_here", "n_kept")
        out = one if out is None else out.unionByName(one)
    return out


_BITS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
win AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM p),
often AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT win.doc_id, unnest([i, i + 1, i + 2]) AS j FROM win JOIN often USING (doc_id, g)) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(ln.n - ln.u, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(ln.n, 0) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
  FROM d LEFT JOIN ln ON d.doc_id = ln.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id
), b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper > n_letters THEN 32 ELSE 0 END + CASE WHEN 5 * n_bangs > n_words THEN 64 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
"""
ORACLE = _BITS + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits % 4) <> 0 AS base_failed, (fail_bits & 119) = 0 AS kept, fail_bits FROM b"
ABLATIONS = _BITS + """, pol AS (SELECT * FROM (VALUES ('base', 3), ('prose-1', 127), ('prose-2', 119)) v(policy, mask)),
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('many_symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('shouting', 32), ('exclamations', 64)) r(rule, bit))
SELECT policy, rule, count(*) FILTER (WHERE (fail_bits & bit) <> 0) AS n_failed, count(*) FILTER (WHERE (fail_bits & mask) = bit) AS n_only_here, count(*) FILTER (WHERE (fail_bits & mask) = 0) AS n_kept
FROM pol JOIN r ON (bit & mask) <> 0 CROSS JOIN b GROUP BY policy, rule"""
