"""Training examples: messages, prompts, token examples with masked labels, selection."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import message, quoted, strip, user_content

DEFAULT_SYSTEM = "You design reusable bundles. Given the user request, output ONLY a valid JSON blueprint. No explanations, no markdown fences."
IGNORED = -100
EOS = "<|im_end|>"


def messages(instruction: Column, context: Column, target: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """System, user and assistant turns; nothing else of the record enters."""
    return F.array(message("system", F.lit(system)), message("user", user_content(instruction, context)), message("assistant", target))


def prompt(instruction: Column, exemplars: list[tuple[str, str]], mode: str = "zero-shot", system: str = DEFAULT_SYSTEM) -> Column:
    """Messages up to the user's turn; few-shot takes exactly three exemplar pairs."""
    if mode not in ("zero-shot", "few-shot") or mode == "few-shot" and len(exemplars) != 3 or mode == "zero-shot" and exemplars:
        raise ValueError("zero-shot takes no exemplars and few-shot exactly three")
    shots = [m for u, a in exemplars for m in (message("user", F.lit(u)), message("assistant", F.lit(a)))]
    return F.array(message("system", F.lit(system)), *shots, message("user", instruction))


def regex_tokens(text: Column) -> Column:
    """A deterministic stand-in for a model's tokenizer: turn marks, runs of word characters, single signs, white space."""
    return F.regexp_extract_all(text, F.lit(r"<\|im_start\|>|<\|im_end\|>|[A-Za-z0-9_]+|\s+|[^A-Za-z0-9_\s]"), 0)


def example(full: Column, prompt_: Column, assistant_only: bool = True, eos: str = EOS) -> tuple[Column, Column]:
    """(tokens, labels) as arrays: white space after the end mark goes, the prompt must be an exact prefix.

    An example that doesn't end in the end mark, or whose prompt is no prefix, gives null for both.
    """
    n = F.size(full)
    trailing = F.aggregate(F.reverse(full), F.struct(F.lit(0).alias("k"), F.lit(False).alias("stop")), lambda a, t: F.struct((a["k"] + F.when(~a["stop"] & (t != eos) & (strip(t) == ""), 1).otherwise(0)).alias("k"), (a["stop"] | (t == eos) | (strip(t) != "")).alias("stop")))["k"]
    ids = F.slice(full, 1, n - trailing)
    ok = (F.element_at(ids, -1) == eos) & (F.slice(ids, 1, F.size(prompt_)) == prompt_)
    labels = F.concat(F.array_repeat(F.lit(str(IGNORED)), F.size(prompt_)), F.slice(ids, F.size(prompt_) + 1, F.greatest(F.size(ids) - F.size(prompt_), F.lit(0)))) if assistant_only else ids
    return F.when(ok, ids), F.when(ok, labels)


def unmasked(tokens: Column, labels: Column) -> Column:
    """The text of the tokens that train."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), labels.alias("l")), lambda x: x["l"] != str(IGNORED))
    return F.array_join(F.transform(kept, lambda x: x["t"]), "")


def select_examples(df: DataFrame, policy: str, limit: int, *, length: str, pos: str) -> DataFrame:
    """The first or the shortest records, up to a limit."""
    if policy not in ("first", "shortest"):
        raise ValueError(f"unknown policy {policy!r}")
    return df.orderBy(*([length, pos] if policy == "shortest" else [pos])).limit(limit)


def parameter_count(layers: DataFrame, rank: int = 16, depth: int = 28) -> DataFrame:
    """Adapter parameters of (name, d_in, d_out): rank times the sum of both, over all layers of that depth."""
    return layers.withColumn("adapter_params", (F.lit(rank) * (F.col("d_in") + F.col("d_out")) * depth).cast("bigint"))


def memory_bytes(layers: DataFrame, params: str, rank: int = 16, depth: int = 28) -> DataFrame:
    """Bytes that training takes: all parameters at 12 bytes, or half a byte each and 4 for every parameter of the adapters."""
    out = parameter_count(layers, rank, depth)
    return out.withColumn("full_bytes", F.col(params).cast("double") * 12).withColumn("adapter_bytes", F.col(params).cast("double") * 0.5 + F.col("adapter_params") * 4.0)


def resolved(argument: str | None, environment: str | None, default: str, allowed: tuple[str, ...] = ()) -> str:
    """A setting by argument, then environment, then default; one that isn't allowed is refused."""
    value = argument or environment or default
    if allowed and value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return value


def resolved_setting(argument: Column, environment: Column, default: str, allowed: tuple[str, ...] = ()) -> Column:
    """resolved() for columns: a struct of the value and of why it is refused, one of them null."""
    value = F.coalesce(F.nullif(argument, F.lit("")), F.nullif(environment, F.lit("")), F.lit(default))
    good = value.isin(*allowed) if allowed else F.lit(True)
    why = F.concat(quoted(value), F.lit(f" is none of {', '.join(allowed)}"))
    return F.struct(F.when(good, value).alias("value"), F.when(~good, why).alias("refused"))


#: Texts whose tokens are Python objects at a time, and their characters.
TOKEN_ROWS, TOKEN_CHARS = 64, 1 << 20


def token_lists(texts, tokenizer):
    """Lists of tokens as an Arrow array, from an Arrow array of texts; Python's objects are those of a few texts at a time."""
    kind, out, held, chars = pa.list_(pa.string()), [], [], 0
    for t in texts:
        t = t.as_py()
        held.append(None if t is None else list(tokenizer(t)))
        chars += len(t or "")
        if len(held) >= TOKEN_ROWS or chars >= TOKEN_CHARS:
            out.append(pa.array(held, kind))
            held, chars = [], 0
    return pa.concat_arrays([*out, pa.array(held, kind)])


def tokens_by(text: Column, tokenizer) -> Column:
    """Tokens by a function of the caller's, text to list of strings, over Arrow batches; regex_tokens() is the default stand-in."""
    from pyspark.sql import types as T

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return token_lists(texts, tokenizer)

    return run(text)


def recommended_length(vram_gb: Column, capability: Column) -> Column:
    return F.when((vram_gb < 16) | (capability < 7), 2048).otherwise(8192)
