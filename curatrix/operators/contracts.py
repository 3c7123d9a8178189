"""Behaviour contracts in Markdown: which sections are there, and whether each statement carries one provenance label.

A section runs from a heading of level 2 to the next one; deeper headings and guidance (lines from `>`) are no
statements. A statement is a list item or a paragraph with the indented lines under it; a bare list mark is none.
A null text counts as empty. All of it is column expressions over one row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section titles and labels of the contract format.
SECTIONS = (
    "Purpose and expected outcomes", "Trigger conditions", "Negative triggers", "Inputs, context, assumptions, prerequisites", "Step-by-step behavior", "Decision rules and branches",
    "Steering instructions", "Failure handling and recovery", "Safety and permission boundaries", "Evidence and verification", "Stopping conditions", "Output contract",
    "Required and optional capabilities", "Resource requirements", "Acceptance criteria and test scenarios", "Crazy Thing", "Explicit uncertainties and unresolved questions",
)
OPTIONAL = ("Crazy Thing",)
LABELS = ("USER", "DESIGNER", "ASSUMED", "OPEN")

_MARK = r"(?:[-*+]|\d{1,9}[.)])"
_NEXT = rf"\n(?={_MARK}(?:[ \t\n]|\z))|\n[ \t]*\n(?=\S)"


def _statements(part: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(part, r"\A[^\n]*", ""), r"(?md)^(?:>|#{1,6}[ \t])[^\n]*", "")
    return F.filter(F.split(body, _NEXT), lambda s: s.rlike(r"\S") & ~s.rlike(rf"\A\s*{_MARK}\s*\z"))


def _title(part: Column) -> Column:
    head = F.regexp_extract(part, r"\A##[ \t]+(?:\d{1,9}[.)][ \t]*)?([^\n]*)", 1)
    return F.lower(F.rtrim(head, F.lit(" \t.")))


def sections(text: Column) -> Column:
    """An array of (title in lower case, for each statement its labels)."""
    whole = F.coalesce(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(""))
    parts = F.filter(F.split(whole, r"(?md)^(?=##[ \t])"), lambda p: p.rlike(r"\A##[ \t]"))
    labels = lambda s: F.regexp_extract_all(s, F.lit(rf"\[({'|'.join(LABELS)})\]"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(_title(p).alias("title"), F.transform(_statements(p), labels).alias("labels")))


def lint(df: DataFrame, text: str, *, wanted: tuple[str, ...] = SECTIONS, optional: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """df with a struct `lint`: titles that are missing, repeated or without a statement, counts of statements by their
    labels, and whether the contract is finished: every section that isn't optional once, none empty, one label each."""
    names = F.array(*(F.lit(w.lower()) for w in wanted))
    found = F.transform(F.col("_sections"), lambda s: s["title"])
    times = lambda w: F.size(F.filter(found, lambda t: t == w))
    each = F.flatten(F.transform(F.col("_sections"), lambda s: s["labels"]))
    count = lambda test: F.size(F.filter(each, test))
    only = lambda w: lambda x: (F.size(x) == 1) & F.array_contains(x, w)
    needed = F.array(*(F.lit(w.lower()) for w in wanted if w not in optional))
    seen = df.withColumn("_sections", sections(F.col(text)))
    facts = [
        F.filter(needed, lambda w: times(w) == 0).alias("missing"),
        F.filter(names, lambda w: times(w) > 1).alias("repeated"),
        F.filter(names, lambda w: F.exists("_sections", lambda s: (s["title"] == w) & (F.size(s["labels"]) == 0))).alias("empty"),
        F.size(each).alias("n_statements"),
        count(lambda x: F.size(x) == 0).alias("n_unlabelled"),
        count(lambda x: F.size(x) > 1).alias("n_overlabelled"),
        *(count(only(w)).alias(f"n_{w.lower()}") for w in LABELS),
    ]
    seen = seen.withColumn("lint", F.struct(*facts)).drop("_sections")
    clean = F.lit(True)
    for c in ("missing", "repeated", "empty"):
        clean = clean & (F.size(f"lint.{c}") == 0)
    return seen.withColumn("lint", F.col("lint").withField("finished", clean & (F.col("lint.n_unlabelled") == 0) & (F.col("lint.n_overlabelled") == 0)))
