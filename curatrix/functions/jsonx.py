"""JSON text as VARIANT, without letting a cast hide what type a value has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import once


def parsed(col: Column) -> Column:
    """The value, or null for anything but one whole JSON text: `{"a":1} x` and `{},{}` don't pass."""
    one = F.json_array_length(F.concat(F.lit("["), col, F.lit("]"))) == 1
    return F.when(one, F.try_parse_json(col))


def kind(v: Column, path: str) -> Column:
    """The type at a path as text: `VOID` for JSON null, SQL null where nothing is there."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_string(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path) == "STRING", F.lit(False))


def is_array(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path).startswith("ARRAY"), F.lit(False))


def string(v: Column, path: str) -> Column:
    """The string at a path; null for other types."""
    return F.when(is_string(v, path), F.try_variant_get(v, path, "string"))


def elements(v: Column, path: str) -> Column:
    """The elements of the array at a path; empty for other types."""
    return F.coalesce(F.when(is_array(v, path), F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))


@F.pandas_udf(T.StringType())
def _strict(s):
    """JSON text without NaN and repeated keys, of what Python's own reader takes; null of what it refuses."""
    import json

    def one(x):
        if x is None:
            return None
        try:
            # NaN and the infinities stay numbers, as their type is all that is asked of them; of repeated keys the last counts.
            return json.dumps(json.loads(x, parse_constant=lambda _: 1.0))
        except (TypeError, ValueError, RecursionError):
            return None

    return s.map(one)


#: How a text begins that either reader takes; most prose doesn't, and a parser that refuses it takes longer than this look.
_BEGINS = r"\A[ \t\r\n]*(?:[\[{\"0-9-]|true|false|null|NaN|Infinity)"


def exactly(col: Column) -> Column:
    """As parsed(), and also what only Python's own reader takes: NaN, infinities, repeated keys. Only what parsed() refuses, and begins as JSON does, goes to Python."""
    # What col is made by is worked out once before Python and once after it, not for each use.
    taken = once(col, lambda x: F.when(x.rlike(_BEGINS), parsed(x)))
    refused = once(col, lambda x: F.when(x.rlike(_BEGINS) & parsed(x).isNull(), x))
    return F.coalesce(taken, F.try_parse_json(_strict(refused)))


def with_exactly(df: DataFrame, col: Column, out: str) -> DataFrame:
    """df with `out` = exactly(col). Rows that parsed() takes, and nulls, pass a branch without Python; the rest go through the other."""
    v = parsed(col)
    odd = col.isNotNull() & v.isNull()
    return df.where(~odd).withColumn(out, v).unionByName(df.where(odd).withColumn(out, F.try_parse_json(_strict(col))))


def none(v: Column, path: str) -> Column:
    """Whether nothing, or JSON null, is at a path."""
    k = kind(v, path)
    return k.isNull() | (k == "VOID")


def comparable(v: Column, path: str) -> Column:
    """The value at a path as text that is equal for equal values: whole and broken numbers and booleans by their number; null for none()."""
    k = kind(v, path)
    number = k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")
    return (
        F.when(none(v, path), None)
        .when(k == "STRING", F.concat(F.lit("s:"), F.try_variant_get(v, path, "string")))
        .when(number, F.concat(F.lit("n:"), F.try_variant_get(v, path, "double").cast("string")))
        .when(k == "BOOLEAN", F.when(F.try_variant_get(v, path, "boolean"), "n:1.0").otherwise("n:0.0"))
        .otherwise(F.concat(F.lit("j:"), F.to_json(F.try_variant_get(v, path, "variant"))))
    )


def exactly_parsed(col: Column) -> Column:
    """Whether Python's own reader takes the text: NaN and repeated keys pass."""
    return exactly(col).isNotNull()
