"""Selection, assembly, near duplicates and splits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assemble, near_dup, select, splits
from .profile_queries import t


def _bundles(spark, sf):
    """Documents as copies of bundles: source is the repository, paths and names follow from the id."""
    d = t(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    top = F.get(F.array(*map(F.lit, ("skills", ".agents/skills", "pkg", "docs"))), (F.col("doc_id") % 4).cast("int"))
    name = F.concat(F.lit("item-"), F.col("doc_id") % 97)
    return d.select("doc_id", F.col("source").alias("repo"), name.alias("skill_name"), F.concat(top, F.lit("/"), name).alias("relpath"), "lang", "n_chars")


def canonical_dedup(spark, sf):
    b = select.canonical(_bundles(spark, sf).withColumn("relpath", F.concat("relpath", F.lit("/"), F.col("doc_id"))))
    return b.select("repo", "skill_name", "relpath", text.record_id(F.col("repo"), F.col("skill_name")).alias("id"))


_QUOTAS = {"en": 40, "de": 15, "fr": 12, "es": 500}


def stratified_quota_sample(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    return select.quota_sample(d, _QUOTAS).select("id", "domain", F.col("rank").cast("bigint").alias("rank"))


def quota_shortfall(spark, sf):
    return select.shortfalls(t(spark, sf, "documents").select(F.col("lang").alias("domain")), _QUOTAS | {"it": 3})


def exclusion_antijoin(spark, sf):
    ex = t(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return t(spark, sf, "documents").select("doc_id", "source").join(ex, "doc_id", "left_anti")


_LICENCES = (
    "Apache License, Version 2.0, January 2004", "Copyright. Permission is hereby granted under the MIT terms", "This is a limited grant", "BSD 3-Clause", "CC0 1.0 Universal",
    "This is free and unencumbered software (unlicense)", "All rights reserved",
)


def _licence_text():
    return F.get(F.array(*map(F.lit, _LICENCES)), (F.col("p_partkey") % 9).cast("int"))


def licence_classify(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", _licence_text().alias("own"), F.when(F.col("p_size") % 3 == 0, "MIT").when(F.col("p_size") % 3 == 1, "Proprietary").alias("repo"))
    p = p.select("p_partkey", text.licence(F.col("own")).alias("own"), text.licence(F.col("repo")).alias("repo"))
    first = text.first_found_licence(F.nullif("own", F.lit("unknown")), F.nullif("repo", F.lit("unknown")))
    return p.select("p_partkey", F.col("own").alias("licence"), text.effective_licence(F.col("own"), F.col("repo")).alias("effective"), first.alias("converter"))


def document_licence(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.licence(F.col("text")).alias("licence"), text.is_stub(F.col("text")).alias("stub"))


def name_normalise(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("-"), F.col("p_name"), F.lit("_ "), F.col("p_type"), F.lit("--")).alias("raw"))
    return p.select("p_partkey", text.normal_name(F.col("raw")).alias("name"))


def name_validity(spark, sf):
    n = F.get(F.array(F.lit("ok-name"), F.lit("Bad"), F.lit("a--b"), F.lit("a"), F.lit("-a"), F.concat(F.lit("a"), F.lit("\n")), F.lit("claude"), F.col("p_name")), (F.col("p_partkey") % 8).cast("int"))
    p = t(spark, sf, "part").select("p_partkey", n.alias("n"))
    return p.select("p_partkey", text.valid_name(F.col("n")).alias("is_valid"), F.col("n").isin(*text.RESERVED_NAMES).alias("reserved"))


def path_safety(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.get(F.array(F.lit("a..b"), F.lit("/x"), F.lit("scripts/a.py"), F.lit("references/b.md"), F.lit("assets/c"), F.lit("SKILL.md"), F.lit("docs/SKILL.md"), F.lit("../up")), (F.col("p_partkey") % 8).cast("int")).alias("path"))
    return p.select("p_partkey", text.unsafe_path(F.col("path")).alias("unsafe"), text.file_purpose(F.col("path")).alias("purpose"))


def repo_slugs(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", text.repo_slug(F.concat(F.lower("c_mktsegment"), F.lit("_"), F.translate("c_name", "#", "_"))).alias("slug"))


def domain_classify(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("repo"), F.get(F.array(*map(F.lit, ("design/copy-kit", "finance/x", "other/seo-tool", "other/sql-report", "other/zzz", "other/blog-writer"))), (F.col("p_partkey") % 6).cast("int")).alias("rel"))
    name = F.element_at(F.split("rel", "/"), -1)
    brands = ("Brand#11", "Brand#12", "Brand#13", "Brand#1", "Brand#2")
    return p.select("p_partkey", select.domain(F.col("repo"), F.col("rel"), name, repo_domains={"Brand#21": "sales", "Brand#3": "sales"}, category_repos=brands).alias("domain"))


def front_matter_sections(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("text").alias("x"))
    main = F.concat(F.lit("---\nname: doc-"), F.col("doc_id"), F.lit("\ndescription: one two\n---\n# Title\n\n"), F.col("x"), F.lit("\n\n## When to use\n- first\n* second\n1. third\nplain\n\n## When not to use\n- never\n"))
    d = d.withColumn("main", main).withColumn("b", text.body(main))
    return d.select("doc_id", text.front_matter_field(F.col("main"), "name").alias("name"), F.array_join(text.section_items(F.col("b"), text.WHEN_USE), "|").alias("use"), F.array_join(text.section_items(F.col("b"), text.WHEN_NOT), "|").alias("not_use"), F.md5(text.first_paragraph(F.col("b"))).alias("paragraph_md5"))


def _assembled(spark, sf):
    """Records and errors: whole texts as instructions, and all of each from the fifth character on as description."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("_pos"), F.col("lang").alias("domain"), F.col("source").alias("repo"), "text")
    ins = d.where("id % 11 <> 0").select("id", F.col("text").alias("instruction"))
    bps = d.where("id % 7 <> 0").select("id", F.expr("substring(text, 5)").alias("description"), F.lit("{}").alias("blueprint"))
    return assemble.assemble(d.drop("text"), ins, bps)


def assemble_errors(spark, sf):
    return _assembled(spark, sf)[1].select("id", "error")


def _dataset(spark, sf):
    b = t(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = b.union(b.select(F.col("id") + 100000, F.concat(F.expr("substring(text, 4)"), F.lit("zz")))).withColumn("_pos", F.col("id"))
    when = lambda k, bad, good: F.when(F.col("id") % 5 == k, bad).otherwise(F.lit(good))
    blueprint = F.concat(F.lit('{"name":"'), when(1, "Item_", "item-"), F.col("id"), F.lit('","description":"d","files":'), when(2, "[]", '[{"path":"SKILL.md"}]'), F.lit("}"))
    bps = d.select("id", F.lit("d").alias("description"), blueprint.alias("blueprint"), F.concat(F.lit('{"validation_errors":'), when(3, '["x"]', "[]"), F.lit("}")).alias("provenance"))
    sel = d.select("id", "_pos", F.lit("d").alias("domain"), F.lit("r").alias("repo"))
    return assemble.build(sel, d.select("id", F.col("text").alias("instruction")), bps)


def dataset_errors(spark, sf):
    """All checks of a dataset over whole benchmark texts and shifted copies of them, with faults in blueprints by id."""
    return _dataset(spark, sf)[1].select("id", "error")


def dataset_records(spark, sf):
    """The training rows of the same dataset, as they are written."""
    r = _dataset(spark, sf)[0]
    return r.select(F.col("metadata.id").alias("id"), F.md5("instruction").alias("instruction_md5"), F.md5("expected_blueprint").alias("blueprint_md5"), "metadata.domain", "metadata.repo", "metadata.provenance")


def near_dup_pairs(spark, sf):
    return near_dup.near_dup_pairs(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def near_dup_clusters(spark, sf):
    return near_dup.near_dup_clusters(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def exact_dup_collapse(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", "text")
    return splits.collapse_exact(d, "lang", "text", "doc_id").select("doc_id", "lang")


def majority_domain(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("source").alias("cluster"), F.col("lang").alias("dom"))
    return splits.majority_domain(d, "cluster", "dom", "doc_id")


_SIZES = {"train": 800, "val": 100, "test": 100}


def proportional_split(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang")
    return splits.deal_simple(d, _SIZES, domain="lang", key="doc_id").select("doc_id", "split", "rank")


def capacity_deal(spark, sf):
    d = near_dup_clusters(spark, sf).join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    n = d.count()
    sizes = {"train": n * 8 // 10, "val": n // 10, "test": n // 10}
    return splits.deal(d.withColumnRenamed("cluster", "grp"), sizes, cluster="grp", domain="lang", pos="doc_id").select("doc_id", "grp", "split")


def balanced_shards(spark, sf):
    return splits.shards(t(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "shard")


def split_manifest_hash(spark, sf):
    return splits.content_hash(t(spark, sf, "documents").select("lang", "text"), "lang", "text")


def leakage_check(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    ids = t(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    return splits.exemplar_leaks(ids, d.where("id % 10 < 8"), d.where("id % 10 = 8"), d.where("id % 10 = 9"))


def exemplar_band(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("_size"))
    return d.select("doc_id", F.col("_size").between(5000, 10000).alias("in_band"))


def exemplar_lookup(spark, sf):
    """Fixed ids in their order, each in the size band; here three of the documents whose length is inside."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("_size"))
    ids = [r[0] for r in d.where("_size BETWEEN 5000 AND 10000").orderBy(F.desc("id")).limit(3).collect()]
    return splits.exemplars(d, ids).select("id", "lang", F.col("_size").alias("n_chars"))


def sequence_matcher_near_dup(spark, sf):
    b = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("x"))
    more = b.select((F.col("item_id") + 100000).alias("item_id"), F.concat(F.expr("substring(x, 4)"), F.lit("zz")).alias("x"))
    return near_dup.sequence_near_dups(b.union(more), "item_id", "x")


def skip_counters(spark, sf):
    d = t(spark, sf, "documents").select(F.col("source").alias("repo"), text.is_stub(F.col("text")).alias("stub"), text.effective_licence(text.licence(F.col("text")), F.when(F.col("doc_id") % 2 == 0, "mit")).alias("licence"), (F.col("doc_id") % 13 == 0).alias("excluded"))
    return select.skip_counts(d)


def cache_filter(spark, sf):
    return assemble.uncached(t(spark, sf, "documents").select("doc_id", "lang"), t(spark, sf, "labels"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        canonical_dedup, stratified_quota_sample, quota_shortfall, exclusion_antijoin, licence_classify, document_licence, name_normalise, name_validity, path_safety, repo_slugs, domain_classify, front_matter_sections,
        assemble_errors, dataset_errors, dataset_records, exemplar_lookup, near_dup_pairs, near_dup_clusters, exact_dup_collapse, majority_domain, proportional_split, capacity_deal, balanced_shards, split_manifest_hash, leakage_check, exemplar_band, sequence_matcher_near_dup, skip_counters, cache_filter,
    )
}

_LIC = """CASE WHEN {x} IS NULL THEN 'unknown' WHEN contains(lower(left({x}, 400)), 'apache license') AND contains(lower(left({x}, 400)), 'version 2.0') THEN 'apache-2.0'
  WHEN contains(lower(left({x}, 400)), 'mit') THEN 'mit' WHEN contains(lower(left({x}, 400)), 'bsd') THEN 'bsd' WHEN contains(lower(left({x}, 400)), 'cc0') THEN 'cc0'
  WHEN contains(lower(left({x}, 400)), 'unlicense') THEN 'unlicense' ELSE 'present (unparsed)' END"""
_PERM = "('mit', 'apache-2.0', 'bsd', 'cc0', 'unlicense')"
_HINTS = " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{d}'" for p, d in select.NAME_HINTS)
_CATS = " ".join(f"WHEN cat = '{k}' THEN '{v}'" for k, v in select.CATEGORY_DOMAIN.items())
_PAIRS = """
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
df AS (SELECT tok, count(*) AS df FROM w GROUP BY tok),
p AS (SELECT doc_id, tok FROM (SELECT w.doc_id, w.tok, n.n, row_number() OVER (PARTITION BY w.doc_id ORDER BY df.df, w.tok) AS r FROM w JOIN n ON w.doc_id = n.doc_id JOIN df ON w.tok = df.tok) WHERE r <= n - (4 * n) // 5),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.tok = b.tok AND a.doc_id < b.doc_id),
k AS (SELECT c.a, c.b, count(*) AS k FROM c JOIN w x ON x.doc_id = c.a JOIN w y ON y.doc_id = c.b AND x.tok = y.tok GROUP BY c.a, c.b),
pairs AS (SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * k > 4 * greatest(na.n, nb.n))
"""
ORACLE_SQL = {
    "canonical_dedup": """
      WITH b AS (SELECT source AS repo, 'item-' || (doc_id % 97) AS skill_name, CASE doc_id % 4 WHEN 0 THEN 'skills' WHEN 1 THEN '.agents/skills' WHEN 2 THEN 'pkg' ELSE 'docs' END || '/item-' || (doc_id % 97) || '/' || doc_id AS relpath, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS s FROM documents)
      SELECT repo, skill_name, relpath, repo || '__' || skill_name AS id FROM (SELECT *, row_number() OVER (PARTITION BY repo, skill_name ORDER BY s, relpath) AS r FROM b) WHERE r = 1""",
    "stratified_quota_sample": "SELECT id, domain, rank FROM (SELECT doc_id AS id, lang AS domain, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= CASE domain WHEN 'en' THEN 40 WHEN 'de' THEN 15 WHEN 'fr' THEN 12 WHEN 'es' THEN 500 END",
    "quota_shortfall": "SELECT q.d AS domain, count(doc_id) AS have, CAST(w AS BIGINT) AS want FROM (VALUES ('en', 40), ('de', 15), ('fr', 12), ('es', 500), ('it', 3)) q(d, w) LEFT JOIN documents ON lang = q.d GROUP BY q.d, w HAVING count(doc_id) < w",
    "exclusion_antijoin": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "licence_classify": f"""
      WITH p AS (SELECT p_partkey, CASE p_partkey % 9 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LICENCES))} END AS own, CASE p_size % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Proprietary' END AS repo FROM part),
      l AS (SELECT p_partkey, {_LIC.format(x='own')} AS own, {_LIC.format(x='repo')} AS repo FROM p)
      SELECT p_partkey, own AS licence, CASE WHEN own IN {_PERM} THEN own WHEN repo IN {_PERM} THEN repo END AS effective, CASE WHEN own <> 'unknown' THEN own WHEN repo <> 'unknown' THEN repo ELSE 'unknown' END AS converter FROM l""",
    "document_licence": f"SELECT doc_id, {_LIC.format(x='text')} AS licence, regexp_matches(lower(text), 'status:\\s*moved') OR contains(lower(text), 'signpost') OR contains(lower(text), 'no longer developed here') OR contains(regexp_extract(lower(text), '(?s)^---\\s*\\n(.*?)\\n---', 1), 'deprecated compatibility entry') AS stub FROM documents",
    "name_normalise": "SELECT p_partkey, trim(regexp_replace(translate(lower('-' || p_name || '_ ' || p_type || '--'), '_ ', '--'), '-+', '-', 'g'), '-') AS name FROM part",
    "name_validity": r"SELECT p_partkey, regexp_matches(n, '^[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?\n?$') AND NOT contains(n, '--') AS is_valid, n IN ('claude', 'anthropic') AS reserved FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'ok-name' WHEN 1 THEN 'Bad' WHEN 2 THEN 'a--b' WHEN 3 THEN 'a' WHEN 4 THEN '-a' WHEN 5 THEN 'a' || chr(10) WHEN 6 THEN 'claude' ELSE p_name END AS n FROM part)",
    "path_safety": """SELECT p_partkey, contains(p, '..') OR starts_with(p, '/') AS unsafe, CASE WHEN list_last(string_split(p, '/')) = 'SKILL.md' THEN 'Main skill definition: YAML frontmatter plus Markdown instructions.' WHEN starts_with(p, 'scripts/') THEN 'Executable helper script used by the skill.' WHEN starts_with(p, 'references/') THEN 'Reference documentation loaded on demand.' WHEN starts_with(p, 'assets/') THEN 'Static asset or template bundled with the skill.' ELSE 'Supporting file bundled with the skill.' END AS purpose
      FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'a..b' WHEN 1 THEN '/x' WHEN 2 THEN 'scripts/a.py' WHEN 3 THEN 'references/b.md' WHEN 4 THEN 'assets/c' WHEN 5 THEN 'SKILL.md' WHEN 6 THEN 'docs/SKILL.md' ELSE '../up' END AS p FROM part)""",
    "repo_slugs": "SELECT c_custkey, regexp_replace(lower(c_mktsegment) || '_' || translate(c_name, '#', '_'), '^([^_]*)_', '\\1/') AS slug FROM customer",
    "domain_classify": f"""
      WITH p AS (SELECT p_partkey, p_brand AS repo, CASE p_partkey % 6 WHEN 0 THEN 'design/copy-kit' WHEN 1 THEN 'finance/x' WHEN 2 THEN 'other/seo-tool' WHEN 3 THEN 'other/sql-report' WHEN 4 THEN 'other/zzz' ELSE 'other/blog-writer' END AS rel FROM part),
      q AS (SELECT p_partkey, repo, split_part(rel, '/', 1) AS cat, split_part(rel, '/', 2) AS n FROM p),
      r AS (SELECT p_partkey, CASE WHEN repo IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#1', 'Brand#2') THEN CASE WHEN cat = 'design' AND contains(n, 'copy') THEN 'writing' {_CATS} END END AS c, CASE WHEN repo IN ('Brand#21', 'Brand#3') THEN 'sales' END AS m, CASE {_HINTS} ELSE 'business' END AS h FROM q)
      SELECT p_partkey, coalesce(c, m, h) AS domain FROM r""",
    "front_matter_sections": r"""
      WITH d AS (SELECT doc_id, '# Title' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## When to use' || chr(10) || '- first' || chr(10) || '* second' || chr(10) || '1. third' || chr(10) || 'plain' || chr(10) || chr(10) || '## When not to use' || chr(10) || '- never' || chr(10) AS b FROM documents),
      l AS (SELECT doc_id, b, list_transform(string_split(b, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')) AS ls FROM d),
      h AS (SELECT doc_id, b, ls, list_filter(range(1, len(ls) + 1), lambda i: starts_with(ls[i], '#')) AS heads FROM l),
      t AS (SELECT *, list_filter(heads, lambda i: regexp_matches(lower(regexp_replace(ls[i], '^#+', '')), 'when to use|use cases?|triggers?|activat'))[1] AS u,
                      list_filter(heads, lambda i: regexp_matches(lower(regexp_replace(ls[i], '^#+', '')), 'when not to use|don''?t use|limitations?|out of scope|not suitable|avoid when'))[1] AS n FROM h),
      p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(b, '\n\s*\n'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '---'))[1] AS par FROM d)
      SELECT t.doc_id, 'doc-' || t.doc_id AS name,
        array_to_string(list_filter(list_transform(ls[u + 1:coalesce(list_filter(heads, lambda i: i > u)[1] - 1, len(ls))], lambda x: regexp_replace(regexp_replace(x, '^([-*]\s+|\d+[.)]\s+)', ''), '\s+$', '')), lambda x: x <> ''), '|') AS use,
        array_to_string(list_filter(list_transform(ls[n + 1:coalesce(list_filter(heads, lambda i: i > n)[1] - 1, len(ls))], lambda x: regexp_replace(regexp_replace(x, '^([-*]\s+|\d+[.)]\s+)', ''), '\s+$', '')), lambda x: x <> ''), '|') AS not_use,
        md5(left(regexp_replace(coalesce(par, ''), '\s+', ' ', 'g'), 500)) AS paragraph_md5
      FROM t JOIN p ON t.doc_id = p.doc_id""",
    "assemble_errors": r"""
      WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') END AS ins, CASE WHEN doc_id % 7 <> 0 THEN substr(text, 5) END AS descr FROM documents),
      w AS (SELECT *, row_number() OVER (PARTITION BY ins ORDER BY id) AS r FROM d WHERE ins IS NOT NULL AND descr IS NOT NULL)
      SELECT id, 'missing blueprint' AS error FROM d WHERE descr IS NULL UNION ALL SELECT id, 'missing instruction' FROM d WHERE descr IS NOT NULL AND ins IS NULL
      UNION ALL SELECT id, 'instruction too short' FROM w WHERE length(ins) < 40 UNION ALL SELECT id, 'duplicate instruction' FROM w WHERE r > 1
      UNION ALL SELECT id, 'instruction copies description' FROM w WHERE length(descr) > 20 AND contains(ins, descr)""",
    "dataset_records": """
      WITH d AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT item_id + 100000, substr(text, 4) || 'zz' FROM benchmark)
      SELECT id, md5(trim(text)) AS instruction_md5, md5('{"name":"' || CASE id % 5 WHEN 1 THEN 'Item_' ELSE 'item-' END || id || '","description":"d","files":' || CASE id % 5 WHEN 2 THEN '[]' ELSE '[{"path":"SKILL.md"}]' END || '}') AS blueprint_md5,
             'd' AS domain, 'r' AS repo, '{"validation_errors":' || CASE id % 5 WHEN 3 THEN '["x"]' ELSE '[]' END || '}' AS provenance FROM d""",
    "exemplar_lookup": "SELECT doc_id AS id, lang, n_chars FROM documents WHERE n_chars BETWEEN 5000 AND 10000 ORDER BY doc_id DESC LIMIT 3",
    "near_dup_pairs": _PAIRS + "SELECT a, b FROM pairs",
    "near_dup_clusters": _PAIRS + ", e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a) SELECT x AS doc_id, min(y) AS cluster FROM reach GROUP BY x",
    "exact_dup_collapse": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "majority_domain": "SELECT cluster, dom AS domain, CAST(size AS BIGINT) AS size FROM (SELECT source AS cluster, lang AS dom, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r, sum(count(*)) OVER (PARTITION BY source) AS size FROM documents GROUP BY source, lang) WHERE r = 1",
    "proportional_split": "SELECT doc_id, CASE WHEN rank % 10 < 8 THEN 'train' WHEN rank % 10 = 8 THEN 'val' ELSE 'test' END AS split, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY lang, md5('7:' || doc_id), doc_id) - 1 AS rank FROM documents)",
    "balanced_shards": "SELECT doc_id, (row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1) % (SELECT CASE WHEN count(*) > 100 THEN (count(*) + 99) // 100 ELSE 1 END FROM documents) AS shard FROM documents",
    "split_manifest_hash": """
      WITH h AS (SELECT lang, sha256(text) AS h FROM documents), leaf AS (SELECT lang, left(h, 4) AS d, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY lang, d)
      SELECT lang, CAST(sum(n) AS BIGINT) AS n_records, sha256(string_agg(d || ':' || h, chr(10) ORDER BY d || ':' || h)) AS sha256 FROM leaf GROUP BY lang""",
    "capacity_deal": _PAIRS.rstrip() + """,
      e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
      g AS (SELECT x AS doc_id, min(y) AS grp FROM reach GROUP BY x), gd AS (SELECT g.doc_id, grp, lang FROM g JOIN documents d ON g.doc_id = d.doc_id),
      m AS (SELECT grp, lang, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, min(doc_id)) AS r, sum(count(*)) OVER (PARTITION BY grp) AS size FROM gd GROUP BY grp, lang),
      o AS (SELECT grp, CAST(size AS BIGINT) AS size, row_number() OVER (ORDER BY lang, md5('7:' || grp), grp) AS rn FROM m WHERE r = 1),
      tot AS (SELECT count(*) AS n FROM documents), pat AS (SELECT n * 8 // 10 AS a, n // 10 AS b, list_concat(list_transform(range(0, (n * 8 // 10) // (n // 10)), lambda x: 1), [2, 3]) AS p FROM tot),
      f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seat, a AS r1, b AS r2, b AS r3, CAST(0 AS BIGINT) AS s FROM pat
            UNION ALL
            SELECT rn, CASE WHEN j IS NULL THEN seat ELSE (seat + j + 1) % len(p) END, r1 - CASE WHEN s = 1 THEN size ELSE 0 END, r2 - CASE WHEN s = 2 THEN size ELSE 0 END, r3 - CASE WHEN s = 3 THEN size ELSE 0 END, s
            FROM (SELECT *, CAST(CASE WHEN j IS NULL THEN list_position([r1, r2, r3], greatest(r1, r2, r3)) ELSE p[CAST((seat + j) % len(p) + 1 AS INT)] END AS BIGINT) AS s
                  FROM (SELECT o.rn, f.seat, f.r1, f.r2, f.r3, o.size, pat.p, list_filter(range(0, len(pat.p)), lambda j: [f.r1, f.r2, f.r3][pat.p[CAST((f.seat + j) % len(pat.p) + 1 AS INT)]] >= o.size)[1] AS j FROM f JOIN o ON o.rn = f.rn + 1 CROSS JOIN pat)))
      SELECT gd.doc_id, gd.grp, CASE f.s WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END AS split FROM f JOIN o ON f.rn = o.rn JOIN gd ON gd.grp = o.grp""",
    "leakage_check": "SELECT item_id AS id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 < 8) OR item_id IN (SELECT doc_id FROM documents WHERE doc_id % 10 >= 8)",
    "exemplar_band": "SELECT doc_id, n_chars BETWEEN 5000 AND 10000 AS in_band FROM documents",
    "skip_counters": f"""WITH d AS (SELECT source, doc_id, {_LIC.format(x='text')} AS own, regexp_matches(lower(text), 'status:\\s*moved') OR contains(lower(text), 'signpost') OR contains(lower(text), 'no longer developed here') AS stub FROM documents)
      SELECT CASE WHEN doc_id % 13 = 0 THEN 'excluded' WHEN stub THEN 'stub:' || source WHEN own NOT IN {_PERM} AND doc_id % 2 <> 0 THEN source ELSE 'pool' END AS reason, count(*) AS n FROM d GROUP BY 1""",
    "cache_filter": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
