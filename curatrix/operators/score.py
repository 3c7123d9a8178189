"""Layered scoring of structured outputs: parse, schema, field fidelity, files; then rates and scores.

Errors are structs (code, field, idx, value); their text is rendered last. Nothing is written to disk:
whether a bundle can be laid out is decided from its paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.stats import composite
from ..functions.text import once, quoted, strip, strip_fences, token_set, unsafe_path, valid_name
from ..staging import staged

#: Required fields in the order they are checked, and their types.
STRINGS = ("blueprint_version", "name", "description", "purpose")
LISTS = ("when_to_use", "when_not_to_use", "files")

_ERROR = "struct<code:string,field:string,idx:int,value:string>"


def _error(code: str, field: Column | str | None = None, idx: Column | None = None, value: Column | None = None) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    return F.struct(F.lit(code).alias("code"), text(field).alias("field"), (F.lit(None) if idx is None else idx).cast("int").alias("idx"), text(value).alias("value"))


def _if(cond: Column, error: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), error)


def schema_errors(v: Column, kinds: Column | None = None) -> Column:
    """Ordered errors of a parsed value against the blueprint schema; kinds holds the fields' types where they are known."""
    kind = lambda k: jsonx.kind(v, f"$.{k}") if kinds is None else kinds[k]
    errors = []
    for k in (*STRINGS, *LISTS):
        errors.append(_if(kind(k).isNull(), _error("missing", k)))
        good = kind(k) == "STRING" if k in STRINGS else kind(k).startswith("ARRAY")
        errors.append(_if(kind(k).isNotNull() & ~good, _error("type", k)))
    name = F.when(kind("name").isNull(), F.lit("")).otherwise(jsonx.string(v, "$.name"))
    errors.append(_if(name.isNotNull() & ~valid_name(name), _error("name", value=name)))
    plain = F.coalesce(F.try_variant_get(v, "$.description", "string"), F.lit(""))
    numeric = kind("description").isin("BIGINT", "DOUBLE") | kind("description").startswith("DECIMAL")
    blank = (
        kind("description").isNull() | (kind("description") == "VOID") | ((kind("description") == "STRING") & (plain == ""))
        | ((kind("description") == "BOOLEAN") & (plain == "false")) | (numeric & (F.try_variant_get(v, "$.description", "double") == 0))
        | (jsonx.is_array(v, "$.description") & (F.size(jsonx.elements(v, "$.description")) == 0)) | (kind("description") == "OBJECT<>")
    )
    errors.append(_if(blank, _error("description")))
    files = jsonx.elements(v, "$.files")
    is_list = jsonx.is_array(v, "$.files")
    errors.append(_if(is_list & (F.size(files) == 0), _error("no_files")))

    def of_file(f, i):
        each = [_if(~jsonx.is_object(f), _error("file_type", idx=i))]
        for k in ("path", "purpose", "content"):
            each.append(_if(jsonx.is_object(f) & (F.coalesce(jsonx.string(f, f"$.{k}"), F.lit("")) == ""), _error("file_field", k, i)))
            if k == "path":
                each.append(_if(jsonx.is_object(f) & unsafe_path(jsonx.string(f, "$.path")), _error("file_path", "path", i, jsonx.string(f, "$.path"))))
        # A path's own error comes after the checks of all three fields.
        return F.array(each[0], each[1], each[3], each[4], each[2])

    entries = F.flatten(F.transform(files, of_file))
    main = F.exists(files, lambda f: F.coalesce(jsonx.is_object(f) & (jsonx.string(f, "$.path") == "SKILL.md"), F.lit(False)))
    tail = [_if(is_list & ~main, _error("no_main"))]
    for k in ("when_to_use", "when_not_to_use"):
        texts = F.forall(jsonx.elements(v, f"$.{k}"), lambda e: F.coalesce(F.schema_of_variant(e) == "STRING", F.lit(False)))
        tail.append(_if(jsonx.is_array(v, f"$.{k}") & ~texts, _error("list_items", k)))
    whole = F.array_compact(F.concat(F.array(*errors), entries, F.array(*tail)))
    return F.when(jsonx.is_object(v), whole).otherwise(F.array(_error("not_object"))).cast(f"array<{_ERROR}>")


def error_text(e: Column) -> Column:
    """An error struct in words."""
    at = F.concat(F.lit("files["), e["idx"].cast("string"), F.lit("]"))
    return (
        F.when(e["code"] == "not_object", "blueprint is not an object")
        .when(e["code"] == "missing", F.concat(F.lit("missing field: "), e["field"]))
        .when(e["code"] == "type", F.concat(F.lit("field "), e["field"], F.lit(" has wrong type")))
        .when(e["code"] == "name", F.concat(F.lit("invalid name: "), quoted(e["value"])))
        .when(e["code"] == "description", "empty description")
        .when(e["code"] == "no_files", "files is empty")
        .when(e["code"] == "file_type", F.concat(at, F.lit(" not an object")))
        .when(e["code"] == "file_field", F.concat(at, F.lit("."), e["field"], F.lit(" missing/empty")))
        .when(e["code"] == "file_path", F.concat(at, F.lit(".path unsafe: "), quoted(e["value"])))
        .when(e["code"] == "no_main", "files missing SKILL.md")
        .otherwise(F.concat(e["field"], F.lit(" must be list[str]")))
    )


def blueprint_errors(output: Column) -> Column:
    """What is wrong with an output's text, in words; empty if it is a valid blueprint."""
    kinds = lambda v: F.struct(*(jsonx.kind(v, f"$.{k}").alias(k) for k in (*STRINGS, *LISTS)))
    wrong = lambda v: F.when(v.isNull(), F.array(F.lit("L1 parse failure: output is not valid JSON"))).otherwise(once(kinds(v), lambda k: F.transform(schema_errors(v, k), error_text)))
    bare = F.when(output.contains("```"), strip_fences(output)).otherwise(strip(output))
    return once(jsonx.exactly(bare), wrong)


def f1(a: Column, b: Column) -> Column:
    """F1 of two sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    p, r = both / F.size(a), both / F.size(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | (both == 0), 0.0).otherwise(2 * p * r / (p + r))


def paths(v: Column) -> Column:
    """The distinct paths of a value's file entries; an entry without one counts as one more."""
    entries = F.filter(jsonx.elements(v, "$.files"), jsonx.is_object)
    return F.array_distinct(F.transform(entries, lambda f: F.coalesce(jsonx.comparable(f, "$.path"), F.lit(""))))


def field_scores(pred: Column, ref: Column) -> tuple[Column, Column, Column]:
    """Exact name match (of any type; nothing equals null), F1 of file paths, F1 of description tokens."""
    words = lambda v: token_set(F.coalesce(jsonx.string(v, "$.description"), F.lit("")))
    same = jsonx.comparable(pred, "$.name").eqNullSafe(jsonx.comparable(ref, "$.name"))
    return F.when(same, 1.0).otherwise(0.0), f1(paths(pred), paths(ref)), f1(words(pred), words(ref))


_HEAD = r"(?sU)\A---\s*\n(.*?)\n---\s*\n"
_FAILED = "materialize error"


def file_errors(v: Column) -> Column:
    """Why a bundle's files can't be laid out, in order; empty if they can.

    Files are laid out in turn, and the first that can't be decides: an unsafe path, or an entry that is
    no object, has no text as path, has something else than text as content, or needs a place that a
    file or folder before it took. Content that is absent is empty; of files of one path the last counts.
    """
    # "." and empty parts of a path name no folder.
    plain = lambda p: F.array_join(F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")), "/")
    good = lambda f: jsonx.is_object(f) & jsonx.is_string(f, "$.path") & (jsonx.kind(f, "$.content").isNull() | jsonx.is_string(f, "$.content"))

    def entry(f):
        return once(F.struct(jsonx.string(f, "$.path").alias("p"), plain(jsonx.string(f, "$.path")).alias("n")), lambda x: laid(f, x["p"], x["n"]))

    def laid(f, path, name):
        broken = ~good(f) | (name == "") | path.contains("\x00") | F.exists(F.split(name, "/"), lambda x: F.octet_length(x) > 255)
        return F.struct(F.when(unsafe_path(path), path).alias("unsafe"), F.coalesce(broken, F.lit(True)).alias("broken"), name.alias("name"), F.coalesce(jsonx.string(f, "$.content"), F.lit("")).alias("content"))

    return once(F.transform(jsonx.elements(v, "$.files"), entry), lambda files: _layout(v, files))


def _layout(v: Column, files: Column) -> Column:
    under = lambda x, y: x["name"].startswith(F.concat(y["name"], F.lit("/")))
    taken = lambda f, i: F.exists(F.slice(files, 1, i), lambda g: under(f, g) | under(g, f))
    faults = F.transform(files, lambda f, i: F.when(f["unsafe"].isNotNull(), F.concat(F.lit("unsafe path: "), f["unsafe"])).when(f["broken"] | taken(f, i), _FAILED))
    first = F.get(F.array_compact(faults), 0)
    kind = jsonx.kind(v, "$.files")
    no_list = kind.isNotNull() & ~kind.startswith("ARRAY") & ~kind.isin("OBJECT<>") & ~((kind == "STRING") & (F.try_variant_get(v, "$.files", "string") == ""))
    main = F.get(F.filter(F.reverse(files), lambda f: f["name"] == "SKILL.md"), 0)["content"]
    folder = F.exists(files, lambda f: f["name"].startswith("SKILL.md/"))
    read = F.regexp_replace(main, "\r\n?", "\n")
    head = F.when(read.rlike(_HEAD), F.regexp_extract(read, _HEAD, 1))
    text = lambda s: F.array(F.lit(s))
    fields = F.array_compact(F.array(*(F.when(~head.rlike(rf"(?mdU)^{k}:\s*\S"), f"frontmatter missing {k}:") for k in ("name", "description"))))
    return (
        F.when(F.coalesce(no_list, F.lit(False)), text(_FAILED))
        .when(first.isNotNull(), F.array(first))
        .when(main.isNull() & folder, text(_FAILED))
        .when(main.isNull(), text("SKILL.md not materialized"))
        .when(head.isNull(), text("SKILL.md frontmatter missing"))
        .otherwise(fields)
    )


def score_items(preds: DataFrame, refs: DataFrame, *, key: str = "id", output: str = "output", ref: str = "ref", pos: str = "_pos", exact: bool = True) -> DataFrame:
    """One row for each prediction with the layers it reached; of references that share a key the last counts.

    exact: outputs that only Python's own JSON reader takes (NaN, repeated keys) parse, too; without it no row leaves the JVM.
    """
    parse = jsonx.with_exactly if exact else lambda df, col, out: df.withColumn(out, jsonx.parsed(col))
    # Texts are parsed before they meet, so each side alone is read by both branches of the parser.
    last = parse(refs.select(key, pos, F.col(ref).alias("_ref")), F.col("_ref"), "_r")
    last = last.groupBy(key).agg(F.max_by(F.struct("_ref", "_r"), pos).alias("_last")).select(key, "_last.*")
    df = parse(preds, strip_fences(F.col(output)), "_v").join(last, key, "left")
    known = F.col("_ref").isNotNull()
    ok = known & F.col("_v").isNotNull()
    em, pf, df1 = field_scores(F.col("_v"), F.col("_r"))
    df = df.withColumn("has_ref", known).withColumn("l1_parse", F.when(known, F.col("_v").isNotNull()))
    df = df.withColumn("_e", F.when(ok, schema_errors(F.col("_v")))).withColumn("l5_errors", F.when(ok, F.when(jsonx.is_object(F.col("_v")), file_errors(F.col("_v"))).otherwise(F.array(F.lit("materialize error")))))
    return df.select(
        *(F.col(c) for c in preds.columns), "has_ref", "l1_parse", F.transform("_e", error_text).alias("l2_errors"), (F.size("_e") == 0).alias("l2_valid"),
        F.when(ok, em).alias("name_em"), F.when(ok, pf).alias("file_path_f1"), F.when(ok, df1).alias("desc_token_f1"), (F.size("l5_errors") == 0).alias("l5_materialize"), "l5_errors",
    )


def summary(items: DataFrame) -> DataFrame:
    """Rates over all predictions, field means over parsed ones, and the composite score."""
    rate = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")) / F.count("*"), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    agg = items.agg(F.count("*").alias("n"), rate("l1_parse").alias("l1"), rate("l2_valid").alias("l2"), rate("l5_materialize").alias("l5"), mean("name_em").alias("l3_name"), mean("file_path_f1").alias("l3_paths"), mean("desc_token_f1").alias("l3_desc"))
    agg = agg.withColumn("l3", (F.col("l3_name") + F.col("l3_paths") + F.col("l3_desc")) / 3)
    raw, norm = composite(F.col("l1"), F.col("l2"), F.col("l3"), F.col("l5"))
    return agg.withColumn("score_raw", raw).withColumn("score", norm)


def judge_means(items: DataFrame, judge: str, criteria: tuple[str, ...]) -> DataFrame:
    """Mean of each criterion over judged rows (a map column, null where the judge failed), and their number."""
    return items.where(F.col(judge).isNotNull()).agg(F.count("*").alias("n"), *(F.avg(F.col(judge)[c]).alias(c) for c in criteria))


def judge_payload(v: Column, chars: int = 6000) -> Column:
    """What a judge is shown of a parsed value."""
    return F.substring(F.to_json(v), 1, chars)


def judge_reply(reply: Column, criteria: tuple[str, ...]) -> Column:
    """The scores in a judge's reply: its outermost braces as JSON, null where there is none or a criterion is missing."""
    v = jsonx.parsed(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    scores = [F.try_variant_get(v, f"$.{c}", "double") for c in criteria]
    whole = v.isNotNull()
    for x in scores:
        whole = whole & x.isNotNull()
    return F.when(whole, F.create_map(*(y for c, x in zip(criteria, scores, strict=True) for y in (F.lit(c), x))))


#: Error codes by the first pattern that an error's text matches.
CODES = tuple(f"E{i}" for i in range(1, 11))
RULES = (
    ("^blueprint is not an object", "E1"),
    ("^missing field:", "E2"),
    (r"has wrong type|must be list\[str\]", "E3"),
    ("^invalid name:", "E4"),
    (r"^files is empty|^files missing SKILL\.md|^files\[\d+\]", "E5"),
    ("unsafe", "E6"),
    ("^empty description", "E7"),
)


def error_code(text: Column) -> Column:
    out = F.when(text.rlike(RULES[0][0]), RULES[0][1])
    for pattern, code in RULES[1:]:
        out = out.when(text.rlike(pattern), code)
    return out.otherwise("E10")


def item_codes(items: DataFrame, out: str = "codes") -> DataFrame:
    """The codes of each item, by number; empty if it passes.

    The items are written first: the optimiser would otherwise put the whole validation into every use of its errors.
    """
    items = staged(items, "items")
    l1 = F.coalesce("l1_parse", F.lit(False))
    l2 = F.coalesce("l2_valid", F.lit(False))
    more = F.array_compact(F.array(F.when(l2 & ~F.coalesce("l5_materialize", F.lit(False)), "E8"), F.when(l2 & (F.coalesce("name_em", F.lit(0.0)) == 0), "E9")))
    codes = F.array_distinct(F.concat(F.transform(F.coalesce("l2_errors", F.array().cast("array<string>")), error_code), more))
    number = lambda x: F.substring(x, 2, 3).cast("int")
    by_number = F.array_sort(codes, lambda x, y: F.when(number(x) < number(y), -1).when(number(x) > number(y), 1).otherwise(0))
    return items.withColumn(out, F.when(l1, by_number).otherwise(F.array(F.lit("E10"))))


def taxonomy(items: DataFrame) -> DataFrame:
    """Every code with the number of items that carry it, zeros included."""
    counts = item_codes(items).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    codes = items.sparkSession.createDataFrame([(c,) for c in CODES], "code string")
    return codes.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n_items"))
