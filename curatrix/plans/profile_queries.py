"""Length, domain and structure profiles over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import prep, profile


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _len(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang", "n_chars")


def length_profile(spark, sf):
    return stats.length_stats(_len(spark, sf), "n_chars", ["lang"])


def length_stats_total(spark, sf):
    return stats.length_stats(t(spark, sf, "orders").select("o_totalprice"), "o_totalprice")


def length_nearest_index(spark, sf):
    d = _len(spark, sf)
    q = {n: profile.nearest_index(d, "n_chars", p, ["lang"]).withColumnRenamed("value", n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))}
    return q["p50"].join(q["p90"], "lang").join(q["p95"], "lang")


def truncation_report(spark, sf):
    return stats.truncation(_len(spark, sf), "n_chars", profile.THRESHOLDS)


def length_report(spark, sf):
    return profile.length_report(_len(spark, sf), "n_chars")


def domain_counts(spark, sf):
    d = t(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 != 0, F.col("lang")).otherwise("").alias("lang"))
    return profile.domain_counts(d, "lang")


def _split(col):
    return F.when(col % 10 == 9, "test").when(col % 10 == 8, "val").otherwise("train")


def domain_split_pivot(spark, sf):
    d = t(spark, sf, "documents").select("source", _split(F.col("doc_id")).alias("split"))
    return profile.domain_by_split(d, "source", "split", ["train", "val", "test"])


def top10_longest(spark, sf):
    return profile.longest(_len(spark, sf), "n_chars", "doc_id").select("doc_id", "n_chars")


def top10_of_splits(spark, sf):
    d = _len(spark, sf).withColumn("split", _split(F.col("doc_id")))
    out = None
    for i, s in enumerate(("train", "val", "test")):
        top = profile.longest(d.where(F.col("split") == s), "n_chars", "doc_id").withColumn("ord", F.lit(i))
        out = top if out is None else out.unionByName(top)
    return out.orderBy(F.desc("n_chars"), "ord", "doc_id").limit(10).select("split", "doc_id", "n_chars")


def length_histogram(spark, sf):
    return stats.histogram(_len(spark, sf), "n_chars", 0.0, 6.0, 24)


def length_filter(spark, sf):
    return profile.kept_report(profile.filter_lengths(_len(spark, sf), "n_chars", 4096))


def length_dropped(spark, sf):
    return profile.dropped_keys(profile.filter_lengths(_len(spark, sf), "n_chars", 4096), "doc_id")


def prepare_stats(spark, sf):
    d = profile.filter_lengths(_len(spark, sf).withColumn("split", _split(F.col("doc_id"))), "n_chars", 8192)
    return profile.prepare_stats(d, "split", 100)


def select_shortest(spark, sf):
    return prep.select_examples(_len(spark, sf), "shortest", 50, length="n_chars", pos="doc_id").select("doc_id", "n_chars")


def select_first(spark, sf):
    return prep.select_examples(_len(spark, sf), "first", 50, length="n_chars", pos="doc_id").select("doc_id", "n_chars")


def char_vocabulary(spark, sf):
    return profile.char_vocabulary(t(spark, sf, "benchmark"), "text")


def char_round_trip(spark, sf):
    b = t(spark, sf, "benchmark").select("item_id", "text")
    v = profile.char_vocabulary(b, "text")
    d = profile.char_text(profile.char_codes(b, "text", v), "codes", v)
    return d.select("item_id", F.md5(F.array_join(F.col("codes").cast("array<string>"), ",")).alias("codes_md5"), (F.col("decoded") == F.col("text")).alias("same"))


def context_windows(spark, sf):
    return profile.context_windows(t(spark, sf, "benchmark"), "text").select("item_id", F.col("start").cast("bigint").alias("start"), "window", "next")


def chatml_render(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.struct("turn", "role", F.col("text").alias("content")).alias("m"))
    one = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    rendered = text.chatml(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return one.select("conv_id", F.md5(rendered).alias("rendered_md5"), F.length(rendered).cast("bigint").alias("n_chars"))


def token_lengths(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.size(text.token_set(F.col("text"))).cast("bigint").alias("n_distinct"))


def few_shot_messages(spark, sf):
    b = t(spark, sf, "benchmark").select("item_id", "text")
    m = prep.prompt(F.col("text"), [("first ask", "{}"), ("second ask", "{}"), ("third ask", "{}")], "few-shot", system="be brief")
    return b.select("item_id", F.size(m).cast("bigint").alias("n_messages"), F.md5(text.chatml(m)).alias("prompt_md5"))


def training_messages(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("context"))
    m = prep.messages(F.col("text"), F.col("context"), F.concat(F.lit('{"n":'), F.col("doc_id"), F.lit("}")), system="be brief")
    return d.select("doc_id", F.md5(text.chatml(m)).alias("messages_md5"))


def assistant_mask(spark, sf):
    d = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("ask"), F.col("text").alias("answer"))
    m = [text.message("system", F.lit("be brief")), text.message("user", F.col("ask"))]
    p = F.concat(text.chatml(F.array(*m)), F.lit("<|im_start|>assistant\n"))
    ids, labels = prep.example(prep.regex_tokens(text.chatml(F.array(*m, text.message("assistant", F.col("answer"))))), prep.regex_tokens(p))
    d = d.withColumn("ids", ids).withColumn("labels", labels)
    n = lambda c: F.coalesce(F.size(c), F.lit(-1)).cast("bigint")
    return d.select("item_id", n("ids").alias("n_tokens"), n(F.filter("labels", lambda x: x != "-100")).alias("n_trained"), (prep.unmasked(F.col("ids"), F.col("labels")) == F.concat("answer", F.lit("<|im_end|>"))).alias("verified"))


def caller_tokens(spark, sf):
    """Token counts by a tokenizer that the caller brings."""
    return t(spark, sf, "documents").select("doc_id", F.size(prep.tokens_by(F.col("text"), str.split)).cast("bigint").alias("n_tokens"))


def adapter_parameters(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.col("p_size").alias("d_in"), (F.col("p_size") * 2).alias("d_out"))
    return prep.parameter_count(p, 16, 28).select("p_partkey", "adapter_params")


def adapter_memory(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.col("p_size").alias("d_in"), (F.col("p_size") * 2).alias("d_out"), (F.col("p_partkey") * 1000).alias("params"))
    return prep.memory_bytes(p, "params").select("p_partkey", "full_bytes", "adapter_bytes")


def length_recommendation(spark, sf):
    return t(spark, sf, "part").select("p_partkey", prep.recommended_length(F.col("p_size").cast("double"), F.col("p_size") % 10).cast("bigint").alias("max_seq_length"))


QUERIES = {
    f.__name__: f
    for f in (
        length_profile, length_stats_total, length_nearest_index, truncation_report, length_report, domain_counts, domain_split_pivot, top10_longest, top10_of_splits, length_histogram, length_filter, length_dropped, char_round_trip, caller_tokens, adapter_memory,
        prepare_stats, select_shortest, select_first, char_vocabulary, context_windows, chatml_render, token_lengths, few_shot_messages, training_messages, assistant_mask, adapter_parameters, length_recommendation,
    )
}

_Q = "round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.9), 6) AS p90, round(quantile_cont({c}, 0.95), 6) AS p95, round(quantile_cont({c}, 0.99), 6) AS p99"
_SPLIT = "CASE WHEN doc_id % 10 = 9 THEN 'test' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'train' END"
_LIMITS = "(VALUES (1024), (2048), (4096), (8192), (16384)) l(x)"
_IM = "'<|im_start|>{role}' || chr(10) || {x} || '<|im_end|>' || chr(10)"


def _im(role: str, x: str) -> str:
    return _IM.format(role=role, x=x)


ORACLE_SQL = {
    "length_profile": f"SELECT lang, count(n_chars) AS n_records, round(avg(n_chars), 6) AS mean, {_Q.format(c='n_chars')}, max(n_chars) AS max_len FROM documents GROUP BY lang",
    "length_stats_total": f"SELECT count(o_totalprice) AS n_records, round(avg(o_totalprice), 6) AS mean, {_Q.format(c='o_totalprice')}, CAST(trunc(max(o_totalprice)) AS BIGINT) AS max_len FROM orders",
    "length_nearest_index": """
      WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
      SELECT lang, max(CASE WHEN i = floor(n * CAST(0.5 AS DOUBLE)) + 1 THEN n_chars END) AS p50, max(CASE WHEN i = floor(n * CAST(0.9 AS DOUBLE)) + 1 THEN n_chars END) AS p90,
             max(CASE WHEN i = floor(n * CAST(0.95 AS DOUBLE)) + 1 THEN n_chars END) AS p95 FROM r GROUP BY lang""",
    "truncation_report": f"SELECT CAST(x AS BIGINT) AS threshold, count(*) FILTER (WHERE n_chars > x) AS n_over, round(100.0 * count(*) FILTER (WHERE n_chars > x) / count(*), 6) AS pct_over FROM documents, {_LIMITS} GROUP BY x",
    "length_report": "SELECT count(*) AS total, count(*) FILTER (WHERE n_chars <= 2048) AS fit_2048, count(*) FILTER (WHERE n_chars <= 4096) AS fit_4096, count(*) FILTER (WHERE n_chars <= 6144) AS fit_6144, count(*) FILTER (WHERE n_chars <= 8192) AS fit_8192 FROM documents",
    "domain_counts": "SELECT CASE WHEN doc_id % 10 = 0 THEN 'unknown' ELSE lang END AS domain, count(*) AS n FROM documents GROUP BY 1",
    "domain_split_pivot": f"SELECT source AS domain, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'val') AS val, count(*) FILTER (WHERE s = 'test') AS test FROM (SELECT source, {_SPLIT} AS s FROM documents) GROUP BY source",
    "top10_longest": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10",
    "top10_of_splits": f"""
      SELECT split, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT doc_id, n_chars, {_SPLIT} AS split FROM documents))
      WHERE r <= 10 ORDER BY n_chars DESC, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, doc_id LIMIT 10""",
    "length_histogram": "SELECT CAST(CASE WHEN x = 6 THEN 24 ELSE floor((x - 0.0) / 0.25) + 1 END AS BIGINT) AS bin, count(*) AS n FROM (SELECT log10(CAST(n_chars AS DOUBLE)) AS x FROM documents WHERE n_chars > 0) WHERE x BETWEEN 0 AND 6 GROUP BY 1",
    "length_filter": "SELECT count(*) AS total, count(*) FILTER (WHERE n_chars <= 4096) AS kept, count(*) FILTER (WHERE n_chars > 4096) AS dropped FROM documents",
    "length_dropped": "SELECT doc_id FROM documents WHERE n_chars > 4096",
    "char_round_trip": "WITH v AS (SELECT char, row_number() OVER (ORDER BY char) - 1 AS idx FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark) WHERE char <> ''), c AS (SELECT item_id, i, substr(text, i, 1) AS char FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)) SELECT item_id, md5(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY i)) AS codes_md5, true AS same FROM c JOIN v ON c.char = v.char GROUP BY item_id",
    "caller_tokens": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS BIGINT) AS n_tokens FROM documents",
    "adapter_memory": "SELECT p_partkey, CAST(p_partkey AS DOUBLE) * 1000 * 12 AS full_bytes, CAST(p_partkey AS DOUBLE) * 1000 * 0.5::DOUBLE + 16 * (p_size + p_size * 2) * 28 * 4.0::DOUBLE AS adapter_bytes FROM part",
    "prepare_stats": f"SELECT split, count(*) AS total, count(*) FILTER (WHERE n_chars > 8192) AS excluded, least(count(*) FILTER (WHERE n_chars <= 8192), 100) AS kept FROM (SELECT n_chars, {_SPLIT} AS split FROM documents) GROUP BY split",
    "select_shortest": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 50",
    "select_first": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50",
    "char_vocabulary": "SELECT char, row_number() OVER (ORDER BY char) - 1 AS idx FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark) WHERE char <> ''",
    "context_windows": "SELECT item_id, i AS start, substr(text, i, 32) AS \"window\", substr(text, i + 32, 1) AS next FROM (SELECT item_id, text, unnest(range(1, length(text) - 31)) AS i FROM benchmark WHERE length(text) > 32)",
    "chatml_render": f"SELECT conv_id, md5(s) AS rendered_md5, length(s) AS n_chars FROM (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)",
    "token_lengths": "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)",
    "few_shot_messages": "SELECT item_id, CAST(8 AS BIGINT) AS n_messages, md5(" + " || ".join([_im("system", "'be brief'"), *(x for k in ("first", "second", "third") for x in (_im("user", f"'{k} ask'"), _im("assistant", "'{}'"))), _im("user", "text")]) + ") AS prompt_md5 FROM benchmark",
    "training_messages": "SELECT doc_id, md5(" + " || ".join([_im("system", "'be brief'"), _im("user", "text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '<context>' || chr(10) || source || chr(10) || '</context>' ELSE '' END"), _im("assistant", "'{\"n\":' || doc_id || '}'")]) + ") AS messages_md5 FROM documents",
    "assistant_mask": r"""
      WITH p AS (SELECT item_id, text AS answer, '<|im_start|>system' || chr(10) || 'be brief<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS p FROM benchmark),
      k AS (SELECT item_id, answer, len(regexp_extract_all(p, '<\|im_start\|>|<\|im_end\|>|[A-Za-z0-9_]+|\s+|[^A-Za-z0-9_\s]')) AS a, len(regexp_extract_all(p || answer || '<|im_end|>', '<\|im_start\|>|<\|im_end\|>|[A-Za-z0-9_]+|\s+|[^A-Za-z0-9_\s]')) AS b FROM p)
      SELECT item_id, CASE WHEN NOT regexp_matches(answer, '^\s') THEN CAST(b AS BIGINT) ELSE -1 END AS n_tokens, CASE WHEN NOT regexp_matches(answer, '^\s') THEN CAST(b - a AS BIGINT) ELSE -1 END AS n_trained, CASE WHEN NOT regexp_matches(answer, '^\s') THEN true END AS verified FROM k""",
    "adapter_parameters": "SELECT p_partkey, CAST(16 * (p_size + p_size * 2) * 28 AS BIGINT) AS adapter_params FROM part",
    "length_recommendation": "SELECT p_partkey, CAST(CASE WHEN p_size < 16 OR p_size % 10 < 7 THEN 2048 ELSE 8192 END AS BIGINT) AS max_seq_length FROM part",
}
