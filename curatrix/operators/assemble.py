"""Assembly of records from selection, instructions and blueprints; conversion of bundles; expert cases; attempts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..staging import staged
from . import near_dup


def assemble(selection: DataFrame, instructions: DataFrame, blueprints: DataFrame, *, min_chars: int = 40, verbatim_over: int = 20) -> tuple[DataFrame, DataFrame]:
    """(records, errors) from selection (id, _pos, domain, repo), instructions (id, instruction), blueprints (id, description, blueprint).

    Rows without a blueprint or an instruction give one error and are checked no further; the others
    are tested for length, for an equal earlier instruction and for copying the description. These are
    the tests of texts; build() has all that a dataset must pass.
    """
    j = selection.join(blueprints, "id", "left").join(instructions.select("id", text.strip(F.col("instruction")).alias("instruction")), "id", "left")
    whole = F.col("blueprint").isNotNull() & F.col("instruction").isNotNull()
    again = F.row_number().over(Window.partitionBy(whole, "instruction").orderBy("_pos")) > 1
    tests = F.array_compact(
        F.array(
            F.when(F.col("blueprint").isNull(), "missing blueprint").when(F.col("instruction").isNull(), "missing instruction"),
            F.when(whole & (F.length("instruction") < min_chars), "instruction too short"),
            F.when(whole & again, "duplicate instruction"),
            F.when(whole & (F.length("description") > verbatim_over) & F.contains("instruction", F.col("description")), "instruction copies description"),
        )
    )
    checked = j.withColumn("errors", tests)
    records = checked.where(whole).select("_pos", "instruction", F.col("blueprint").alias("expected_blueprint"), F.struct("id", "domain", "repo").alias("metadata"))
    return records, checked.select("id", "_pos", F.explode("errors").alias("error"))


def build(selection: DataFrame, instructions: DataFrame, blueprints: DataFrame, *, threshold: float = 0.8, **limits) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a dataset: those of assemble(), with the checks of blueprints and of near-duplicate instructions.

    blueprints also has provenance; it and blueprint are JSON text or structs. A blueprint that is no JSON has
    neither name nor files. All pairs of records are compared, in their order; a pair is an error of its first.
    """
    kinds = dict(blueprints.dtypes)
    b = blueprints.withColumns({c: F.to_json(c) for c in ("blueprint", "provenance") if kinds[c].startswith("struct")})
    records, errors = assemble(selection, instructions, b, **limits)
    bp, prov = jsonx.parsed(F.col("expected_blueprint")), jsonx.parsed(F.col("provenance"))
    r = records.withColumn("id", F.col("metadata.id")).join(b.select("id", "provenance"), "id").withColumns({"_bp": bp, "_prov": prov})
    name = F.coalesce(jsonx.string(F.col("_bp"), "$.name"), F.lit(""))
    tests = F.array(
        F.when(~jsonx.is_object(F.col("_prov")), "missing provenance"),
        F.when(F.size(jsonx.elements(F.col("_prov"), "$.validation_errors")) > 0, "blueprint validation errors"),
        F.when(~text.valid_name(name), F.concat(F.lit("invalid name '"), name, F.lit("'"))),
        F.when(F.size(jsonx.elements(F.col("_bp"), "$.files")) == 0, "no files"),
    )
    faults = r.select("id", "_pos", F.explode(F.array_compact(tests)).alias("error"))
    at = lambda i, pos: records.select(F.col("_pos").alias(pos), F.col("metadata.id").alias(i))
    pairs = near_dup.sequence_near_dups(records, "_pos", "instruction", threshold).join(at("id", "a"), "a").join(at("other", "b"), "b")
    near = pairs.select("id", F.col("a").alias("_pos"), F.concat(F.lit("near-dup: "), F.col("id"), F.lit(" <-> "), F.col("other")).alias("error"))
    whole = r.select("_pos", "instruction", "expected_blueprint", F.col("metadata").withField("provenance", F.col("provenance")).alias("metadata"))
    return whole, errors.unionByName(faults).unionByName(near)


def gate(records: DataFrame, errors: DataFrame, show: int = 30) -> DataFrame:
    """The records, or a failure that shows the first errors of all: all or nothing. A dataset passes with both as of build()."""
    first = [f"{r['id']}: {r['error']}" for r in errors.orderBy("_pos", "error").limit(show).collect()]
    if first:
        raise ValueError("\n".join(first))
    return records


def validation_errors(name: Column, description: Column, directory: Column) -> Column:
    """What is wrong with a bundle's name and description."""
    name = F.coalesce(name, F.lit(""))
    shown = text.quoted(name)
    return F.array_compact(
        F.array(
            F.when(~text.valid_name(name), F.concat(F.lit("invalid name: "), shown)),
            F.when(name.isin(*text.RESERVED_NAMES), F.concat(F.lit("reserved name: "), shown)),
            F.when(~name.eqNullSafe(directory), F.concat(F.lit("name "), shown, F.lit(" != directory "), text.quoted(directory))),
            F.when(~F.coalesce(F.length(description).between(1, 1024), F.lit(False)), "description must be 1-1024 chars"),
        )
    )


#: Where bundles are listed.
SOURCE, URL = "skills.sh", "https://skills.sh/"


def convert(bundles: DataFrame, licences: DataFrame | None = None, *, source: str = SOURCE, url_prefix: str = URL) -> DataFrame:
    """(id, blueprint, provenance) from bundles of (repo, relpath, name, main, files: array of (path, content)).

    main is the text of SKILL.md; files are in path order, their content null for binaries. licences are
    (repo, relpath, text) of licence files: the bundle's own decides, else that of its repository, where
    relpath is empty. Name and description are what the YAML of the front matter has.
    """
    b = bundles.withColumn("_yaml", text.front_matter_values(F.col("main"))).withColumn("_name", F.col("_yaml.name")).withColumn("_desc", F.col("_yaml.description"))
    if licences is None:
        b = b.withColumn("_licence", F.lit("unknown"))
    else:
        own = licences.select("repo", "relpath", text.licence(F.col("text")).alias("_own"))
        top = licences.where("relpath = ''").select("repo", text.licence(F.col("text")).alias("_top"))
        b = b.join(own, ["repo", "relpath"], "left").join(top, "repo", "left").withColumn("_licence", text.first_found_licence(F.col("_own"), F.col("_top")))
    b = b.withColumn("_body", text.body(F.col("main")))
    use, not_use = text.section_items(F.col("_body"), text.WHEN_USE), text.section_items(F.col("_body"), text.WHEN_NOT)
    first = text.first_paragraph(F.col("_body"))
    files = F.transform("files", lambda f: F.struct(f["path"].alias("path"), F.concat(text.file_purpose(f["path"]), F.when(f["content"].isNull(), text.BINARY).otherwise("")).alias("purpose"), F.coalesce(text.capped(f["content"]), F.lit("")).alias("content")))
    blueprint = F.struct(
        F.lit("1.0").alias("blueprint_version"), F.col("_name").alias("name"), F.col("_desc").alias("description"), F.coalesce(F.nullif(first, F.lit("")), F.col("_desc")).alias("purpose"),
        F.when(F.size(use) == 0, F.array("_desc")).otherwise(use).alias("when_to_use"), not_use.alias("when_not_to_use"), files.alias("files"),
    )
    slug = text.repo_slug(F.coalesce("repo", F.lit("")))
    url = F.when(slug == "", "").otherwise(F.concat(F.lit(url_prefix), slug, F.lit("/"), F.col("_name")))
    provenance = F.struct(
        F.lit(source).alias("source"), slug.alias("repo"), url.alias("skill_url"), F.col("_licence").alias("license"),
        validation_errors(F.col("_name"), F.col("_desc"), F.col("name")).alias("validation_errors"),
    )
    return b.select(text.record_id(F.col("repo"), F.col("name")).alias("id"), blueprint.alias("blueprint"), provenance.alias("provenance"))


def repair_names(converted: DataFrame) -> DataFrame:
    """Where a record has any error: its name becomes the normal form of its id's tail, in the main file too, and all errors go."""
    bad = F.size("provenance.validation_errors") > 0
    name = text.normal_name(F.element_at(F.split("id", "__"), -1))
    main = lambda c: F.regexp_replace(c, r"(?s)\A(.*?)(^|\n)name:[^\n]*", F.concat(F.lit("$1$2name: "), name))
    files = F.transform("blueprint.files", lambda f: F.when(f["path"] == "SKILL.md", f.withField("content", main(f["content"]))).otherwise(f))
    fixed = F.col("blueprint").withField("name", name).withField("files", files)
    prov = F.col("provenance").withField("original_name", F.when(bad, F.col("blueprint.name"))).withField("name_normalized", bad)
    prov = prov.withField("validation_errors", F.when(bad, F.array().cast("array<string>")).otherwise(F.col("provenance.validation_errors")))
    return converted.select("id", F.when(bad, fixed).otherwise(F.col("blueprint")).alias("blueprint"), prov.alias("provenance"))


def batch_counts(batch: DataFrame, *, status: str = "status", licence: str = "license") -> DataFrame:
    """(kind, value, n): how many of a batch have each status and each licence; an absent one counts as unknown."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for k, c in (("status", status), ("license", licence))))
    return batch.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def uncached(candidates: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What has no output yet."""
    return candidates.join(done.select(key), key, "left_anti")


#: Fields of an expert case (true where null is allowed), and kinds of traps.
CASE_FIELDS = {"id": False, "instruction": False, "source": False, "source_skill": True, "difficulty": False, "trap_type": True, "curation_notes": False, "author": False, "created": False}
TRAPS = ("nonexistent-field", "contradictory", "invalid-name", "sandbox-escape", "scope-creep", "ambiguity", "language-mix")


def case_errors(case: Column, stem: Column, author: str | None = None) -> Column:
    """Errors of an expert case (JSON text) whose file is named stem.json; the schema is closed."""
    v = jsonx.parsed(case)
    kind = lambda k: jsonx.kind(v, f"$.{k}")
    e = []
    for k, nullable in CASE_FIELDS.items():
        e.append(F.when(kind(k).isNull(), f"missing field '{k}'").when(~kind(k).isin("STRING", *(["VOID"] if nullable else [])), f"field '{k}' has wrong type"))
    extra = F.array_sort(F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*map(F.lit, CASE_FIELDS))))
    e.append(F.when(F.size(extra) > 0, F.concat(F.lit("unexpected fields "), F.array_join(extra, ", "))))
    s = lambda k: jsonx.string(v, f"$.{k}")
    e.append(F.when(~F.coalesce(s("id").rlike(r"^E\d{3}$"), F.lit(False)), "id must match E###").when(s("id") != stem, "id differs from the file name"))
    e.append(F.when(s("trap_type").isNotNull() & ~s("trap_type").isin(*TRAPS), "unknown trap_type"))
    for k in ("instruction", "source", "curation_notes"):
        e.append(F.when(s(k).isNotNull() & (text.strip(s(k)) == ""), f"blank {k}"))
    if author is not None:
        e.append(F.when(s("author") != author, "wrong author"))
    return F.when(v.isNull(), F.array(F.lit("invalid JSON"))).when(~jsonx.is_object(v), F.array(F.lit("top level must be an object"))).otherwise(F.array_compact(F.array(*e)))


def missing_cases(ids: DataFrame, n: int = 20, key: str = "id") -> DataFrame:
    """Expected case ids that are absent."""
    want = ids.sparkSession.range(1, n + 1).select(F.format_string("E%03d", F.col("id").cast("int")).alias(key))
    return want.join(ids.select(key), key, "left_anti")


#: How another attempt is asked for.
REPAIR = (
    "\n\nYour previous output was rejected by the Skill Blueprint validator. Previous output:\n",
    "\n\nValidation errors:\n",
    "\n\nFix ALL of these errors and output ONLY a valid JSON Skill Blueprint. No explanations, no markdown fences.",
)


def repair_text(request: Column, output: Column, errors: Column, wording: tuple[str, str, str] = REPAIR) -> Column:
    """The request for another attempt, with the output and what was wrong with it."""
    before, between, after = map(F.lit, wording)
    return F.concat(request, before, output, between, F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n"), after)


def attempt_status(attempts: DataFrame, *, key: str = "request_id", most: int = 3) -> DataFrame:
    """(key, status, n_attempts, output) from attempts (key, attempt, output, valid, failed).

    200 with the first valid output, 502 if the backend failed first, else 422 with the last output cut to 2000 characters.
    """
    a = attempts.where(F.col("attempt") <= most)
    good, broken = F.min(F.when(F.col("valid"), F.col("attempt"))), F.min(F.when(F.col("failed"), F.col("attempt")))
    g = a.groupBy(key).agg(good.alias("_g"), broken.alias("_b"), F.max("attempt").alias("_n"), F.min_by("output", F.when(F.col("valid"), F.col("attempt"))).alias("_out"), F.max_by("output", "attempt").alias("_last"))
    ok, bad = F.col("_g").isNotNull() & (F.col("_b").isNull() | (F.col("_g") < F.col("_b"))), F.col("_b").isNotNull()
    return g.select(key, F.when(ok, 200).when(bad, 502).otherwise(422).alias("status"), F.when(ok, F.col("_g")).when(bad, F.col("_b")).otherwise(F.col("_n")).cast("bigint").alias("n_attempts"), F.when(ok, F.col("_out")).when(~bad, F.substring("_last", 1, 2000)).alias("output"))


def canned(outputs: list[str], attempt: Column) -> Column:
    """A fake backend: its outputs in order, the last one over and over."""
    return F.element_at(F.array(*map(F.lit, outputs)), F.least(attempt, F.lit(len(outputs))))


def generated(requests: DataFrame, generate, prompt: str, out: str = "output") -> DataFrame:
    """Outputs of generate(list of prompts) -> list of texts, by Arrow batch; the model is the caller's."""
    from pyspark.sql import types as T

    schema = T.StructType([*requests.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: generate(pdf[prompt].tolist())})

    return requests.mapInPandas(run, schema)


def attempted(requests: DataFrame, generate, prompt: Column) -> DataFrame:
    """requests with `output` and `failure`: as generated(), but a backend that raises fails its prompt alone.

    A batch that raises is asked again prompt by prompt; failure tells what was raised, and output is null. Only
    prompts go to Python, and outputs come back. A prompt is sent once, however often the outputs are used.
    """
    def one(p):
        try:
            return generate([p])[0], None
        except Exception as e:  # noqa: BLE001 - the backend is the caller's
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("output string, failure string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        asked = prompts.tolist()
        try:
            out = [(x, None) for x in generate(asked)]
        except Exception:  # noqa: BLE001
            out = [one(p) for p in asked]
        return pd.DataFrame(out, columns=["output", "failure"], dtype=object)

    return requests.withColumn("_made", run.asNondeterministic()(prompt)).select(*requests.columns, "_made.output", "_made.failure")


def repair_loop(requests: DataFrame, generate, errors, *, key: str = "id", request: str = "request", rounds: int = 3, wording: tuple[str, str, str] = REPAIR) -> DataFrame:
    """(key, attempt, prompt, output, failure, errors) of all attempts: generate, validate, and ask again with what was wrong.

    errors(output) is an array of texts, empty where the output is good. A round takes only the requests
    whose last output had errors, and is written before the next, so no model is asked twice for a prompt.
    A request whose backend failed, or that came out good, ends there. Requests that repeat a key go on their own.
    A round writes a request once, and beside it what its prompt adds to it.
    """
    turn, log = requests.select(key, F.col(request).alias("_request"), F.lit("").alias("_added")), None
    prompt = F.concat("_request", "_added")
    for n in range(1, rounds + 1):
        made = attempted(turn, generate, prompt).withColumn("attempt", F.lit(n))
        made = staged(made.withColumn("errors", F.when(F.col("failure").isNull(), errors(F.col("output")))), "attempts")
        log = made if log is None else log.unionByName(made)
        turn = made.where(F.size("errors") > 0).select(key, "_request", repair_text(F.lit(""), F.coalesce("output", F.lit("")), F.col("errors"), wording).alias("_added"))
        if n < rounds and turn.isEmpty():
            break
    return log.select(key, "attempt", prompt.alias("prompt"), "output", "failure", "errors")


def loop_status(log: DataFrame, *, key: str = "id") -> DataFrame:
    """(key, status, n_attempts, output, failure, errors) of a repair_loop(): attempt_status() and what the last attempt was told."""
    a = log.select(key, "attempt", "output", F.coalesce(F.size("errors") == 0, F.lit(False)).alias("valid"), F.col("failure").isNotNull().alias("failed"))
    done = attempt_status(a, key=key, most=2**31 - 1)
    last = log.groupBy(key).agg(F.max_by(F.struct("failure", "errors"), "attempt").alias("l"))
    return done.join(last, key).select(key, "status", "n_attempts", "output", "l.failure", "l.errors")


def best_option(scores: Column) -> Column:
    """The index of the highest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def accuracy(answers: DataFrame, scores: str, answer: str) -> DataFrame:
    right = (best_option(F.col(scores)) == F.col(answer)).cast("int")
    return answers.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def flatten_config(config: dict) -> dict[str, object]:
    """Dotted keys; lists stay whole."""
    return text.flat_settings(config)


def config_diff(a: DataFrame, b: DataFrame, ignored: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, value_a, value_b) where two flat configs differ, or those of each group that `by` names."""
    both = a.select(*by, "key", F.col("value").alias("value_a")).join(b.select(*by, "key", F.col("value").alias("value_b")), [*by, "key"], "full_outer")
    differs = ~F.col("value_a").eqNullSafe(F.col("value_b"))
    return both.where(differs & ~F.col("key").isin(*ignored)) if ignored else both.where(differs)
