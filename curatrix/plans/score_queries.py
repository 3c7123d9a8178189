"""Scoring, taxonomy and paired comparison over outputs made from the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import jsonx, stats, text
from ..operators import assemble, compare, profile, score
from ..staging import staged
from .profile_queries import t

# Outputs are JSON text made from ids, with one fault for each remainder of 18, in either engine's SQL.
_GOOD = """concat('{"blueprint_version":"1.0","name":"doc-', CAST({id} AS {s}), '","description":"handles ', lang, ' text of ', source, '","purpose":"p","when_to_use":["a"],"when_not_to_use":["b"],"files":[{"path":"SKILL.md","purpose":"m","content":"---\\\\nname: x\\\\ndescription: y\\\\n---\\\\nbody"},{"path":"scripts/', source, '.py","purpose":"s","content":"c"}]}')"""
_FAULTS = (
    "{g}",
    "substr({g}, 1, 80)",
    "replace({g}, '\"purpose\":\"p\",', '')",
    "replace({g}, '\"name\":\"doc-', '\"name\":\"Doc_')",
    "concat('```json', {nl}, {g}, {nl}, '```')",
    "replace({g}, 'scripts/', '../')",
    "replace({g}, '\"when_to_use\":[\"a\"]', '\"when_to_use\":[1]')",
    "replace({g}, 'SKILL.md', 'docs/SKILL.md')",
    "concat({g}, ' trailing')",
    "'[]'",
    "replace({g}, 'handles ', '')",
    "replace({g}, 'name: x', 'title: x')",
    "regexp_replace({g}, '\"name\":\"doc-[0-9]+\"', '\"name\":1')",
    "replace({g}, ',\"content\":\"c\"', '')",
    "regexp_replace({g}, '\"path\":\"scripts/[^\"]*\",', '')",
    "replace({g}, '\"purpose\":\"p\"', '\"purpose\":NaN')",
    "replace({g}, '{\"blueprint_version\"', '{\"name\":\"first\",\"blueprint_version\"')",
    "replace({g}, '\"name\":\"doc-', {odd})",
)
# A name with both kinds of quotes, a backslash and a line break, as JSON text.
_ODD = ("""concat('"name":"it', chr(39), 's ', chr(92), '"q', chr(92), '" ', chr(92), chr(92), chr(92), 'n')""")


def _sql(spark_side: bool) -> tuple[str, str]:
    """(reference, output) expressions."""
    g = _GOOD.replace("{id}", "doc_id").replace("{s}", "STRING" if spark_side else "VARCHAR")
    if not spark_side:
        g = g.replace("\\\\", "\\")
    nl = "chr(10)"
    cases = " ".join(f"WHEN {i} THEN {f.replace('{g}', 'ref').replace('{nl}', nl).replace('{odd}', _ODD)}" for i, f in enumerate(_FAULTS))
    return g, f"CASE doc_id % 18 {cases} END"


def _runs(spark, sf):
    ref, out = _sql(True)
    d = t(spark, sf, "documents").select("doc_id", "lang", "source").withColumn("ref", F.expr(ref)).withColumn("output", F.expr(out))
    refs = d.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("id"), "ref", F.col("doc_id").alias("_pos"))
    return d.select(F.col("doc_id").alias("id"), "output"), refs


def _items(spark, sf):
    return score.score_items(*_runs(spark, sf))


def json_parse_rate(spark, sf):
    p = _runs(spark, sf)[0]
    return jsonx.with_exactly(p, text.strip_fences(F.col("output")), "v").select("id", F.col("v").isNotNull().alias("l1_parse"))


def schema_errors(spark, sf):
    return _items(spark, sf).select("id", F.array_join("l2_errors", "; ").alias("l2_errors"))


def field_scores(spark, sf):
    return _items(spark, sf).select("id", "name_em", F.round("file_path_f1", 6).alias("file_path_f1"), F.round("desc_token_f1", 6).alias("desc_token_f1"))


def materialise_check(spark, sf):
    return _items(spark, sf).select("id", "l5_materialize", F.array_join("l5_errors", "; ").alias("l5_errors"))


def composite_score(spark, sf):
    s = score.summary(_items(spark, sf))
    return s.select("n", *(F.round(c, 6).alias(c) for c in ("l1", "l2", "l3", "l5", "score_raw", "score")))


def failure_taxonomy(spark, sf):
    return score.taxonomy(_items(spark, sf))


def item_failures(spark, sf):
    return score.item_codes(_items(spark, sf)).select("id", F.array_join("codes", ",").alias("codes"))


def blueprint_stats(spark, sf):
    return profile.blueprint_stats(_runs(spark, sf)[0], "output")[0]


def files_histogram(spark, sf):
    return profile.blueprint_stats(_runs(spark, sf)[0], "output")[1]


def files_mode(spark, sf):
    return profile.mode(files_histogram(spark, sf), "n_files", "n")


def _ab(spark, sf):
    base = t(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("_pos"), (F.col("quality") == 1).alias("l2_valid"), (F.col("toxic") == 0).alias("b"))
    return base.select("id", "_pos", "l2_valid"), base.select("id", "_pos", F.col("b").alias("l2_valid"))


def _pairs(spark, sf):
    return compare.paired(*_ab(spark, sf), "l2_valid")


def paired_counts(spark, sf):
    return compare.paired_counts(_pairs(spark, sf))


def mcnemar_exact(spark, sf):
    return compare.paired_counts(_pairs(spark, sf)).select("only_a", "only_b", F.round(stats.mcnemar(F.col("only_a"), F.col("only_b")), 9).alias("p_value"))


def mcnemar_table(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("only_a"), F.col("n_regionkey").cast("bigint").alias("only_b"))
    return n.select("only_a", "only_b", F.round(stats.mcnemar(F.col("only_a"), F.col("only_b")), 9).alias("p_value"))


def wilson_ci(spark, sf):
    n = t(spark, sf, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.avg("quality").alias("p"))
    lo, hi = stats.wilson(F.col("p"), F.col("n"))
    return n.select("toxic", "n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


def regressions(spark, sf):
    return compare.regressions(_pairs(spark, sf))


def new_passes(spark, sf):
    return compare.new_passes(_pairs(spark, sf))


def new_failures(spark, sf):
    return compare.new_failures(_pairs(spark, sf), t(spark, sf, "labels").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))


def acceptance_gate(spark, sf):
    c = compare.paired_counts(_pairs(spark, sf))
    rate = lambda s: (F.col("both_pass") + F.col(s)) / F.col("n")
    return c.select(compare.accepted(rate("only_b"), rate("only_a"), F.col("only_a")).alias("accepted"))


def bootstrap_ci(spark, sf):
    """Intervals of mean paired differences: of two runs' outcomes, and of two scores of fields."""
    runs = stats.bootstrap_ci(_pairs(spark, sf), "a", "b").withColumn("metric", F.lit("l2_valid"))
    fields = stats.bootstrap_ci(staged(_items(spark, sf).select("id", "file_path_f1", "desc_token_f1"), "fields"), "desc_token_f1", "file_path_f1", reps=1000, seed=7).withColumn("metric", F.lit("fields"))
    return runs.unionByName(fields).select("metric", *(F.round(c, 9).alias(c) for c in ("lo", "hi", "observed")))


def _options(spark, sf):
    """Embeddings as scores of as many options as they have places."""
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("s"), F.reverse("embedding").alias("back"), (F.col("label") % F.size("embedding")).alias("answer"))


def mcq_argmax(spark, sf):
    e = _options(spark, sf)
    return e.select(F.col("id").alias("vec_id"), assemble.best_option(F.col("s")).cast("bigint").alias("predicted"), (assemble.best_option(F.col("s")) == F.col("answer")).alias("correct"))


def mcq_accuracy(spark, sf):
    return assemble.accuracy(_options(spark, sf), "s", "answer").select("n", F.round("accuracy", 6).alias("accuracy"))


def repair_loop_status(spark, sf):
    """Four attempts a request, so requests grow with the table and every fourth attempt is over the limit of three."""
    e = t(spark, sf, "events").select(F.floor(F.col("event_id") / 4).cast("bigint").alias("request_id"), (F.col("event_id") % 4 + 1).alias("attempt"), F.col("props").alias("output"), (F.col("event_type") == "purchase").alias("valid"), (F.col("event_type") == "error").alias("failed"))
    return assemble.attempt_status(e)


def loop_model(prompts: list[str]) -> list[str]:
    """A model that needs as many attempts as a request's number says, and breaks down for some of them at the second."""
    out = []
    for p in prompts:
        n, tries = int(re.match(r"Make (\d+): ", p)[1]), re.findall(r"#try (\d)#", p)
        attempt = int(tries[-1]) + 1 if tries else 1
        if n % 11 == 3 and attempt == 2:
            raise RuntimeError("out of memory")
        good = attempt > n % 4
        head = f'{{"blueprint_version":"1.0","name":"{"doc" if good or attempt < 3 else "Doc"}-{n}","description":"#try {attempt}#","purpose":"p","when_to_use":["a"],"when_not_to_use":["b"],"files":['
        out.append(head + '{"path":"SKILL.md","purpose":"m","content":"c"}]}' if good else f"#try 1# no idea of {n}" if attempt == 1 else head + "]}")
    return out


def repair_loop(spark, sf):
    """Generate, validate and ask again over the documents, whole texts as requests."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Make "), "doc_id", F.lit(": "), "text").alias("request"))
    log = assemble.repair_loop(d, loop_model, score.blueprint_errors)
    last = log.groupBy("id").agg(F.max_by(F.md5("prompt"), "attempt").alias("prompt_md5"))
    return assemble.loop_status(log).join(last, "id").select("id", "status", "n_attempts", "output", "failure", F.array_join("errors", "; ").alias("errors"), "prompt_md5")


def batch_counts(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("status"), F.when(F.col("user_id") % 3 == 0, "mit").when(F.col("user_id") % 3 == 1, "bsd").alias("license"))
    return assemble.batch_counts(e)


def generated_outputs(spark, sf):
    """Outputs of a model that the caller brings, here one that turns the prompt round; and of canned ones."""
    e = t(spark, sf, "events").select("event_id", F.concat("event_type", F.lit(" "), "props").alias("prompt"), assemble.canned(["first", "second"], (F.col("event_id") % 3 + 1).cast("int")).alias("canned"))
    return assemble.generated(e, lambda prompts: [p[::-1] for p in prompts], "prompt").select("event_id", "output", "canned")


def compare_bundle(spark, sf):
    """Counts, rates with their intervals, the difference and the exact test of two runs."""
    c = compare.compare_runs(*_ab(spark, sf), "l2_valid", reps=200)
    return c.select("n", "both_pass", "only_a", "only_b", "both_fail", *(F.round(x, 9).alias(x) for x in ("rate_a", "lo_a", "hi_a", "rate_b", "lo_b", "hi_b", "diff", "p_value", "diff_lo", "diff_hi")))


def repair_prompt(spark, sf):
    e = t(spark, sf, "events").select("event_id", assemble.repair_text(F.col("event_type"), F.col("props"), F.array(F.lit("first"), F.col("event_type"))).alias("x"))
    return e.select("event_id", F.md5("x").alias("prompt_md5"))


def key_difference(spark, sf):
    e = t(spark, sf, "events").select("event_id", jsonx.parsed(F.col("props")).alias("v"))
    keys = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    return e.select("event_id", F.array_join(F.array_sort(F.array_except(F.array(F.lit("k"), F.lit("missing")), keys)), ",").alias("missing_keys"))


def missing_cases(spark, sf):
    ids = t(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.format_string("E%03d", F.col("n_nationkey")).alias("id"))
    return assemble.missing_cases(ids)


def degraded_output(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(F.substring("text", 1, 200)).alias("cut_md5"), F.md5(text.capped(F.col("text"), 1000)).alias("capped_md5"))


def input_guard(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.length("text").between(1, 32000).alias("accepted"))


def run_drop(spark, sf):
    e = _options(spark, sf)
    side = lambda c: e.select("id", assemble.best_option(F.col(c)).alias("predicted"), (assemble.best_option(F.col(c)) == F.col("answer")).alias("correct"))
    d = compare.run_drop(side("s"), side("back"))
    return d.select("n", F.round("accuracy_a", 6).alias("accuracy_a"), F.round("accuracy_b", 6).alias("accuracy_b"), "n_changed", F.round("drop_points", 6).alias("drop_points"))


def judge_payloads(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.concat(F.lit('{"k": "'), F.repeat(F.col("event_type"), 1200), F.lit('"}')).alias("output"))
    return e.select("event_id", F.md5(score.judge_payload(jsonx.parsed(F.col("output")))).alias("payload_md5"))


def judge_replies(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Scores: "), F.col("props"), F.lit(" done"))).when(F.col("event_id") % 3 == 1, F.lit("no braces")).otherwise(F.lit('{"other": 1}')).alias("reply"))
    e = e.withColumn("l4", score.judge_reply(F.col("reply"), ("k",)))
    return score.judge_means(e, "l4", ("k",)).select("n", F.round("k", 6).alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        json_parse_rate, schema_errors, field_scores, materialise_check, composite_score, failure_taxonomy, item_failures, blueprint_stats, files_histogram, files_mode, paired_counts, mcnemar_exact, mcnemar_table, wilson_ci,
        regressions, new_passes, new_failures, acceptance_gate, bootstrap_ci, mcq_argmax, mcq_accuracy, repair_loop_status, repair_loop, batch_counts, generated_outputs, compare_bundle, judge_payloads, repair_prompt, key_difference, missing_cases, degraded_output, input_guard, run_drop, judge_replies,
    )
}

_REF, _OUT = _sql(False)
_D = f"d AS (SELECT doc_id AS id, doc_id, lang, source, ref, {_OUT} AS output, doc_id % 18 AS k, doc_id % 17 <> 0 AS has_ref FROM (SELECT doc_id, lang, source, {_REF} AS ref FROM documents))"
# What each fault leads to, by hand: the oracle knows the faults, not the validator.
_L1 = "k NOT IN (1, 8)"
_L2 = """CASE k WHEN 2 THEN 'missing field: purpose' WHEN 3 THEN 'invalid name: ''Doc_' || id || '''' WHEN 5 THEN 'files[1].path unsafe: ''../' || source || '.py''' WHEN 6 THEN 'when_to_use must be list[str]'
  WHEN 7 THEN 'files missing SKILL.md' WHEN 9 THEN 'blueprint is not an object' WHEN 12 THEN 'field name has wrong type' WHEN 13 THEN 'files[1].content missing/empty' WHEN 14 THEN 'files[1].path missing/empty'
  WHEN 15 THEN 'field purpose has wrong type' WHEN 17 THEN 'invalid name: ' || chr(39) || 'it' || chr(92) || chr(39) || 's "q" ' || chr(92) || chr(92) || chr(92) || 'n' || id || chr(39) ELSE '' END"""
_L5 = "CASE k WHEN 5 THEN 'unsafe path: ../' || source || '.py' WHEN 7 THEN 'SKILL.md not materialized' WHEN 9 THEN 'materialize error' WHEN 11 THEN 'frontmatter missing name:' WHEN 14 THEN 'materialize error' ELSE '' END"
_OK = f"has_ref AND {_L1}"
# Description tokens: handles, lang, text, of, source; fault 10 loses `handles`; lang and source never repeat the others.
_EM = "CASE WHEN k IN (3, 9, 12, 17) THEN 0.0 ELSE 1.0 END"
_PF = "CASE k WHEN 5 THEN 0.5 WHEN 7 THEN 0.5 WHEN 14 THEN 0.5 WHEN 9 THEN 0.0 ELSE 1.0 END"
_DF = "CASE k WHEN 9 THEN 0.0 WHEN 10 THEN round(2 * 1.0 * CAST(0.8 AS DOUBLE) / 1.8, 6) ELSE 1.0 END"
_I = f"{_D}, i AS (SELECT *, {_OK} AS ok, {_L2} AS l2, {_L5} AS l5, {_EM} AS em, {_PF} AS pf, CAST({_DF} AS DOUBLE) AS df FROM d)"
_CODES = "CASE WHEN NOT ok THEN 'E10' WHEN k = 2 THEN 'E2' WHEN k IN (3, 17) THEN 'E4' WHEN k IN (5, 7, 13, 14) THEN 'E5' WHEN k IN (6, 12, 15) THEN 'E3' WHEN k = 9 THEN 'E1' WHEN k = 11 THEN 'E8' ELSE '' END"
_P = "p AS (SELECT doc_id AS id, quality = 1 AS a, toxic = 0 AS b FROM labels)"
_MC = "CASE WHEN n = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) FROM (SELECT unnest(range(0, CAST(kk + 1 AS BIGINT))) AS i))), 9) END AS p_value"
_W = "round({c}({e}, ({p} + z * z / (2 * n) {s} z * sqrt({p} * (1 - {p}) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9)"
_BUNDLE = f"""WITH {_P}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a AND b) AS both_pass, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS both_fail FROM p),
      z AS (SELECT *, (both_pass + only_a) / n AS rate_a, (both_pass + only_b) / n AS rate_b, CAST(1.96 AS DOUBLE) AS z FROM c),
      m AS (SELECT only_a + only_b AS n, least(only_a, only_b) AS kk FROM c), x AS (SELECT id, b::INT - a::INT AS d FROM p)
      SELECT n, both_pass, only_a, only_b, both_fail, round(rate_a, 9) AS rate_a, {_W.format(p='rate_a', s='-', c='greatest', e='0.0')} AS lo_a, {_W.format(p='rate_a', s='+', c='least', e='1.0')} AS hi_a,
        round(rate_b, 9) AS rate_b, {_W.format(p='rate_b', s='-', c='greatest', e='0.0')} AS lo_b, {_W.format(p='rate_b', s='+', c='least', e='1.0')} AS hi_b, round(rate_b - rate_a, 9) AS diff, (SELECT {_MC} FROM m) AS p_value,
        round(t.lo, 9) AS diff_lo, round(t.hi, 9) AS diff_hi FROM z, {stats.bootstrap_sql('x', 200)} t"""
ORACLE_SQL = {
    "json_parse_rate": f"WITH {_D} SELECT id, {_L1} AS l1_parse FROM d",
    "schema_errors": f"WITH {_I} SELECT id, CASE WHEN ok THEN l2 END AS l2_errors FROM i",
    "field_scores": f"WITH {_I} SELECT id, CASE WHEN ok THEN CAST(em AS DOUBLE) END AS name_em, CASE WHEN ok THEN CAST(pf AS DOUBLE) END AS file_path_f1, CASE WHEN ok THEN df END AS desc_token_f1 FROM i",
    "materialise_check": f"WITH {_I} SELECT id, CASE WHEN ok THEN l5 = '' END AS l5_materialize, CASE WHEN ok THEN l5 END AS l5_errors FROM i",
    "composite_score": f"""WITH {_I}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok) / count(*) AS l1, count(*) FILTER (WHERE ok AND l2 = '') / count(*) AS l2, count(*) FILTER (WHERE ok AND l5 = '') / count(*) AS l5,
      (avg(CASE WHEN ok THEN em END) + avg(CASE WHEN ok THEN pf END) + avg(CASE WHEN ok AND k = 10 THEN 2 * CAST(0.8 AS DOUBLE) / 1.8 WHEN ok THEN df END)) / 3 AS l3 FROM i)
      SELECT n, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3, round(l5, 6) AS l5, round(0.25 * l1 + 0.25 * l2 + 0.2 * l3 + 0.15 * l5, 6) AS score_raw, round((0.25 * l1 + 0.25 * l2 + 0.2 * l3 + 0.15 * l5) / 0.85, 6) AS score FROM s""",
    "failure_taxonomy": f"WITH {_I} SELECT c AS code, count(id) AS n_items FROM (SELECT 'E' || unnest(range(1, 11)) AS c) LEFT JOIN (SELECT id, {_CODES} AS e FROM i) ON e = c GROUP BY c",
    "item_failures": f"WITH {_I} SELECT id, {_CODES} AS codes FROM i",
    "blueprint_stats": f"WITH {_D} SELECT count(*) AS total, count(*) FILTER (WHERE k IN (1, 4, 8, 9)) AS parse_failures, CAST(0 AS BIGINT) AS missing_skill_md FROM d",
    "files_histogram": f"WITH {_D} SELECT CAST(2 AS BIGINT) AS n_files, count(*) AS n FROM d WHERE k NOT IN (1, 4, 8, 9)",
    "files_mode": "SELECT CAST(2 AS BIGINT) AS mode",
    "paired_counts": f"WITH {_P} SELECT count(*) FILTER (WHERE a AND b) AS both_pass, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS both_fail, count(*) AS n FROM p",
    "mcnemar_exact": f"WITH {_P}, c AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b FROM p), z AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS kk FROM c) SELECT only_a, only_b, {_MC} FROM z",
    "mcnemar_table": f"WITH z AS (SELECT CAST(n_nationkey AS BIGINT) AS only_a, CAST(n_regionkey AS BIGINT) AS only_b, n_nationkey + n_regionkey AS n, least(n_nationkey, n_regionkey) AS kk FROM nation) SELECT only_a, only_b, {_MC} FROM z",
    "wilson_ci": "WITH s AS (SELECT toxic, count(*) AS n, avg(quality) AS p, CAST(1.96 AS DOUBLE) AS z FROM labels GROUP BY toxic) SELECT toxic, n, round(greatest(0.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS lo, round(least(1.0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS hi FROM s",
    "regressions": f"WITH {_P} SELECT id FROM p WHERE a AND NOT b",
    "new_passes": f"WITH {_P} SELECT id FROM p WHERE NOT a AND b",
    "new_failures": f"WITH {_P} SELECT id FROM p WHERE a AND NOT b AND id % 3 <> 0",
    "acceptance_gate": f"WITH {_P} SELECT avg(b::INT) * 100 >= avg(a::INT) * 100 + 2 AND count(*) FILTER (WHERE a AND NOT b) = 0 AS accepted FROM p",
    "mcq_argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS predicted, list_position(embedding, list_max(embedding)) - 1 = label % len(embedding) AS correct FROM embeddings",
    "mcq_accuracy": "SELECT count(*) AS n, round(avg((list_position(embedding, list_max(embedding)) - 1 = label % len(embedding))::INT), 6) AS accuracy FROM embeddings",
    "batch_counts": "SELECT 'status' AS kind, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'license', CASE user_id % 3 WHEN 0 THEN 'mit' WHEN 1 THEN 'bsd' ELSE 'unknown' END, count(*) FROM events GROUP BY 2",
    "generated_outputs": "SELECT event_id, reverse(event_type || ' ' || props) AS output, CASE event_id % 3 WHEN 0 THEN 'first' ELSE 'second' END AS canned FROM events",
    "judge_payloads": "SELECT event_id, md5(left('{\"k\":\"' || repeat(event_type, 1200) || '\"}', 6000)) AS payload_md5 FROM events",
    "compare_bundle": _BUNDLE,
    "bootstrap_ci": f"""WITH {_P}, x AS (SELECT id, a::INT - b::INT AS d FROM p), {_I.replace("d AS (SELECT doc_id AS id", "docs AS (SELECT doc_id AS id", 1).replace("FROM d)", "FROM docs)")}, y AS (SELECT id, CASE WHEN ok THEN (CASE WHEN k = 10 THEN 2 * CAST(0.8 AS DOUBLE) / 1.8 ELSE df END) - CAST(pf AS DOUBLE) END AS d FROM i)
      SELECT 'l2_valid' AS metric, round(lo, 9) AS lo, round(hi, 9) AS hi, round(observed, 9) AS observed FROM {stats.bootstrap_sql('x', 2000)} UNION ALL SELECT 'fields', round(lo, 9), round(hi, 9), round(observed, 9) FROM {stats.bootstrap_sql('y', 1000, 7)}""",
    "repair_loop_status": """
      WITH e AS (SELECT event_id // 4 AS r, event_id % 4 + 1 AS a, props, event_type FROM events), s AS (SELECT * FROM e WHERE a <= 3),
      g AS (SELECT r, min(CASE WHEN event_type = 'purchase' THEN a END) AS g, min(CASE WHEN event_type = 'error' THEN a END) AS b, max(a) AS n FROM s GROUP BY r),
      f AS (SELECT *, CASE WHEN g IS NOT NULL AND (b IS NULL OR g < b) THEN 200 WHEN b IS NOT NULL THEN 502 ELSE 422 END AS status FROM g)
      SELECT f.r AS request_id, status, CAST(CASE status WHEN 200 THEN g WHEN 502 THEN b ELSE n END AS BIGINT) AS n_attempts, CASE status WHEN 200 THEN s.props WHEN 422 THEN left(s.props, 2000) END AS output
      FROM f JOIN s ON s.r = f.r AND s.a = CASE status WHEN 200 THEN g ELSE n END""",
    "repair_loop": """
      WITH d AS (SELECT doc_id AS id, 'Make ' || doc_id || ': ' || text AS r, doc_id % 4 + 1 AS need, CASE WHEN doc_id % 11 = 3 AND doc_id % 4 > 0 THEN 502 WHEN doc_id % 4 < 3 THEN 200 ELSE 422 END AS status FROM documents),
      a AS (SELECT *, CASE status WHEN 502 THEN 2 WHEN 200 THEN need ELSE 3 END AS n FROM d),
      o AS (SELECT *, '{"blueprint_version":"1.0","name":"' AS h, '-' || id || '","description":"#try ' AS i, '#","purpose":"p","when_to_use":["a"],"when_not_to_use":["b"],"files":[' AS j, chr(10) AS nl FROM a),
      p AS (SELECT *, '#try 1# no idea of ' || id AS o1, h || 'doc' || i || '2' || j || ']}' AS o2, nl || nl || 'Your previous output was rejected by the Skill Blueprint validator. Previous output:' || nl AS x, nl || nl || 'Validation errors:' || nl || '- ' AS y,
        nl || nl || 'Fix ALL of these errors and output ONLY a valid JSON Skill Blueprint. No explanations, no markdown fences.' AS z FROM o)
      SELECT id, status, CAST(n AS BIGINT) AS n_attempts, CASE status WHEN 200 THEN h || 'doc' || i || n || j || '{"path":"SKILL.md","purpose":"m","content":"c"}]}' WHEN 422 THEN h || 'Doc' || i || '3' || j || ']}' END AS output,
        CASE WHEN status = 502 THEN 'RuntimeError: out of memory' END AS failure, CASE status WHEN 200 THEN '' WHEN 422 THEN 'invalid name: ' || chr(39) || 'Doc-' || id || chr(39) || '; files is empty; files missing SKILL.md' END AS errors,
        md5(r || CASE n WHEN 1 THEN '' WHEN 2 THEN x || o1 || y || 'L1 parse failure: output is not valid JSON' || z ELSE x || o2 || y || 'files is empty' || nl || '- files missing SKILL.md' || z END) AS prompt_md5 FROM p""",
    "repair_prompt": "SELECT event_id, md5(event_type || chr(10) || chr(10) || 'Your previous output was rejected by the Skill Blueprint validator. Previous output:' || chr(10) || props || chr(10) || chr(10) || 'Validation errors:' || chr(10) || '- first' || chr(10) || '- ' || event_type || chr(10) || chr(10) || 'Fix ALL of these errors and output ONLY a valid JSON Skill Blueprint. No explanations, no markdown fences.') AS prompt_md5 FROM events",
    "key_difference": "SELECT event_id, CASE WHEN json_exists(props, '$.k') THEN 'missing' ELSE 'k,missing' END AS missing_keys FROM events",
    "missing_cases": "SELECT 'E' || lpad(CAST(i AS VARCHAR), 3, '0') AS id FROM (SELECT unnest(range(1, 21)) AS i) WHERE i % 3 <> 0",
    "degraded_output": "SELECT doc_id, md5(left(text, 200)) AS cut_md5, md5(CASE WHEN length(text) > 1000 THEN left(text, 1000) || chr(10) || '…[truncated]' ELSE text END) AS capped_md5 FROM documents",
    "input_guard": "SELECT doc_id, length(text) BETWEEN 1 AND 32000 AS accepted FROM documents",
    "run_drop": """WITH a AS (SELECT list_position(embedding, list_max(embedding)) - 1 AS x, list_position(list_reverse(embedding), list_max(embedding)) - 1 AS y, label % len(embedding) AS t FROM embeddings)
      SELECT count(*) AS n, round(avg((x = t)::INT), 6) AS accuracy_a, round(avg((y = t)::INT), 6) AS accuracy_b, count(*) FILTER (WHERE x <> y) AS n_changed, round((avg((x = t)::INT) - avg((y = t)::INT)) * 100, 6) AS drop_points FROM a""",
    "judge_replies": "SELECT count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS k FROM events WHERE event_id % 3 = 0 AND json_exists(props, '$.k')",
}
