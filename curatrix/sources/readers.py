"""Sources: record files with explicit schemas and positions, splits, maps, bundles, cases, configs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded, is_binary
from ..operators.splits import ranked
from ..staging import small_side, staged

RECORD = (
    "instruction string, context string, expected_blueprint string, "
    "metadata struct<id:string,domain:string,repo:string,provenance:struct<source:string,repo:string,skill_url:string,license:string,"
    "validation_errors:array<string>,original_name:string,name_normalized:boolean>>"
)
PREDICTION = "id string, output string, model string, mode string, split string, loader string"
SELECTION = "id string, repo string, relpath string, skill_name string, domain string, license string"


def jsonl(spark: SparkSession, paths: str | list[str], schema: str = RECORD) -> DataFrame:
    """Records of JSON lines with `_file` and `_pos`: file order by name, line order inside.

    Blank lines are skipped; a line that is no record fails the query. The position is the file's
    path and the record's place in the scan, which Spark keeps in file order inside a partition.
    """
    paths = [paths] if isinstance(paths, str) else paths
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    at = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())
    return at.withColumn("_pos", F.struct("_path", "_block", "_row")).drop("_path", "_block", "_row")


def numbered(df: DataFrame, order: str = "_pos") -> DataFrame:
    """`_pos` as one number from 0, without gathering rows in one task."""
    return ranked(df, [F.col(order)]).withColumn(order, F.col("rank")).drop("rank")


SPLITS = ("train", "val", "test")


def split_records(spark: SparkSession, folder: str, split: str, limit: int | None = None) -> DataFrame:
    """A split's records in file order, or the first of them."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    pattern = f"{folder}/train_shard_*.jsonl" if split == "train" else f"{folder}/{split}.jsonl"
    df = numbered(jsonl(spark, pattern))
    return df if limit is None else df.where(F.col("_pos") < limit)


def manifest_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """A split by the manifest's file list; test is refused here."""
    if split == "test":
        raise PermissionError("the test split is read by final_test alone")
    text = spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0]
    files = json.loads(text)["files"][split]
    return numbered(jsonl(spark, [f"{folder}/{x}" for x in ([files] if isinstance(files, str) else files)]))


def final_test(spark: SparkSession, folder: str) -> DataFrame:
    """The test split, for the last evaluation only."""
    return numbered(jsonl(spark, f"{folder}/test.jsonl"))


def all_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Train, val and test as one table with `split`."""
    out = None
    for s in SPLITS:
        df = split_records(spark, folder, s).withColumn("split", F.lit(s))
        out = df if out is None else out.unionByName(df)
    return out


def json_map(spark: SparkSession, paths: list[str], key: str = "id", value: str = "instruction") -> DataFrame:
    """(key, value) of JSON objects, one a file, in files or folders; for keys in several paths the last path counts."""
    out = None
    for i, p in enumerate(paths):
        text = spark.read.option("recursiveFileLookup", "true").text(p, wholetext=True)
        df = text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value)).withColumn("_file", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out.groupBy(key).agg(F.max_by(value, "_file").alias(value))


def items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a report's file, or of a folder's in the order of their names, as VARIANT: a list at the top, or an object's `items`."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    v = text.select(F.col("_metadata.file_path").alias("_file"), F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.items", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return v.select("_file", F.posexplode(listed).alias("_at", "item")).select(F.struct("_file", "_at").alias("_pos"), "item")


def files_below(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(rel, content) of the files below a folder, by their paths from there."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    return raw.select(F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(base) + 2})").alias("rel"), "content")


def _placed(folder: str) -> list:
    """repo, relpath and name of a folder repo/.../name."""
    p = F.split(folder, "/")
    return [F.get(p, 0).alias("repo"), F.array_join(F.slice(p, 2, F.size(p)), "/").alias("relpath"), F.element_at(p, -1).alias("name")]


def bundles(spark: SparkSession, root: str, marker: str = "SKILL.md") -> DataFrame:
    """bundles_of() the files below root, which lie as root/repo/.../name/SKILL.md."""
    return bundles_of(files_below(spark, root), marker)


def bundles_of(files: DataFrame, marker: str = "SKILL.md") -> DataFrame:
    """(repo, relpath, name, main, files) of every folder that holds the marker, files below it in path order.

    files are (rel, content): a path from the top and its bytes. Folders of version control are passed over;
    binary files have null content. A file belongs to every marked folder above it, which is found out from
    paths alone: contents join what is known to belong somewhere, and no other file's bytes are shuffled.
    """
    files = files.where(~F.concat(F.lit("/"), "rel").contains("/.git/"))
    paths = files.select("rel")
    dirs = paths.where((F.col("rel") == marker) | F.col("rel").endswith("/" + marker)).select(F.regexp_replace("rel", "/?[^/]*$", "").alias("dir"))
    parts = F.split("rel", "/")
    up = paths.select("rel", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    belongs = staged(up.join(dirs, "dir"), "bundle-paths")
    inside = files.join(small_side(belongs, size="length(rel) + length(dir)"), "rel")
    shown = F.when(~is_binary(F.col("content")), decoded(F.col("content")))
    entry = F.struct(F.expr("substring(rel, length(dir) + if(dir = '', 1, 2))").alias("path"), shown.alias("content"))
    grouped = inside.select("dir", entry.alias("f")).groupBy("dir").agg(F.max(F.when(F.col("f.path") == marker, F.col("f.content"))).alias("main"), F.array_sort(F.collect_list("f")).alias("files"))
    return grouped.select(*_placed("dir"), "main", "files")


def licences(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """licences_of() the files below root; no other file is read."""
    return licences_of(files_below(spark, root, "{" + ",".join(names) + "}"), names)


def licences_of(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(dir, repo, relpath, text) of the first licence file of each folder, by the order of names; relpath is empty for a repository itself."""
    name = F.element_at(F.split("rel", "/"), -1)
    rank = F.array_position(F.array(*map(F.lit, names)), name)
    found = files.where(name.isin(*names)).select(F.regexp_replace("rel", "/?[^/]*$", "").alias("dir"), decoded(F.col("content")).alias("text"), rank.alias("rank"))
    first = found.groupBy("dir").agg(F.min_by("text", "rank").alias("text"))
    return first.select("dir", *_placed("dir")[:2], "text")


def expert_cases(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, case) of E*.json; templates, which begin with an underscore, don't match."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "E*.json").load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("stem"), decoded(F.col("content")).alias("case"))


def questions(spark: SparkSession, path: str | None, local: DataFrame, limit: int | None = 50) -> DataFrame:
    """Multiple-choice questions from a public source, or the local ones where that is absent or empty.

    Source rows are (question, labels, options, key); those whose key isn't a label, or with fewer than two options, are passed over.
    """
    if path is not None:
        try:
            raw = spark.read.schema("question string, labels array<string>, options array<string>, key string, topic string").json(path)
            good = raw.where(F.array_contains("labels", F.col("key")) & (F.size("options") >= 2))
            good = good.select("question", "options", (F.array_position("labels", F.col("key")) - 1).cast("int").alias("answer"), "topic")
            good = good if limit is None else good.limit(limit)
            if not good.isEmpty():
                return good
        except Exception as e:  # noqa: BLE001 - any failure of the source means the local set
            spark.sparkContext._jvm.org.apache.logging.log4j.LogManager.getLogger("curatrix").warn(f"no questions from {path}: {e}")
    return local


def config(spark: SparkSession, path: str) -> dict:
    """A YAML mapping in one small file, by whatever file system holds it; anything else at the top is refused."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML takes the yaml library") from e
    out = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(out, dict):
        raise ValueError(f"{path} is not a mapping")
    return out
