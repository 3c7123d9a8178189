"""Sinks: JSON lines, split folders with manifests, blueprint files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as _splits


def jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One object a line, sorted by range where an order is given, non-ASCII as it is."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("errorifexists").json(path)


def split_folder(df: DataFrame, path: str, *, record: str, pos: str, split: str = "split", shard_size: int = 100, **facts) -> DataFrame:
    """Writes path/split=../shard=../ as text lines, train in balanced shards; returns the manifest, also written there.

    Every split but train is one shard, as readers expect one file of it: a task holds one open file and sorts
    its records, spilling where they are many.
    """
    train = _splits.shards(df.where(F.col(split) == "train"), record, pos, shard_size)
    rest = df.where(F.col(split) != "train").withColumn("shard", F.lit(0).cast("bigint"))
    rows = train.unionByName(rest).select(split, "shard", pos, record)
    rows.repartition(split, "shard").sortWithinPartitions(split, "shard", pos).select(split, "shard", F.col(record).alias("value")).write.partitionBy(split, "shard").mode("errorifexists").text(f"{path}/data")
    spark = df.sparkSession
    out = _splits.manifest(spark, f"{path}/data", pattern="*.txt", **facts).withColumn("file", F.regexp_extract("file", r"(split=[^/]*/shard=[^/]*)/", 1))
    out.write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.schema(out.schema).json(f"{path}/manifest")


def _by_part(df: DataFrame, path: str, key: str, entries: int, text: Column) -> None:
    """One file for about so many rows, dealt by hash: what text makes of all of them."""
    parts = max(1, -(-df.count() // entries))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")
    df.groupBy(part).agg(text.alias("value")).write.partitionBy("part").mode("errorifexists").text(path)


def json_map(df: DataFrame, path: str, key: str, value: str, entries: int = 1000) -> None:
    """JSON objects of keys and values in a folder, about so many entries a file."""
    _by_part(df, path, key, entries, F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))))


def json_items(df: DataFrame, path: str, key: str, under: str | None = None, entries: int = 1000) -> None:
    """Rows as items of JSON lists in a folder, at the top of each file or under a name, about so many items a file."""
    listed = F.collect_list(F.struct(*df.columns))
    _by_part(df, path, key, entries, F.to_json(listed if under is None else F.struct(listed.alias(under))))


def blueprint_lines(df: DataFrame, path: str) -> None:
    """{id, blueprint, provenance} of each record as a line of JSON, in as many files as df has partitions: for any number of records."""
    df.select("id", "blueprint", "provenance").write.mode("errorifexists").json(path)


def blueprints(df: DataFrame, path: str) -> None:
    """{blueprint, provenance} of each record as JSON, in a folder by id: for as many as a file system may have as folders."""
    df.select("id", F.to_json(F.struct("blueprint", "provenance"), {"pretty": "true"}).alias("value")).write.partitionBy("id").mode("errorifexists").text(path)


def _cell(c: str, kind: str) -> Column:
    """A value as reports show it."""
    if kind.startswith("array"):
        shown = F.array_join(F.col(c).cast("array<string>"), ", ")
    elif kind in ("float", "double"):
        shown = F.format_string("%.4f", F.col(c).cast("double"))
    else:
        shown = F.col(c).cast("string")
    return F.coalesce(F.when(F.col(c).isNotNull(), shown), F.lit("None"))


def _table_head(df: DataFrame) -> list[str]:
    return [f"| {' | '.join(x)} |" for x in (df.columns, ["---"] * len(df.columns))]


def _table_row(df: DataFrame) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(_cell(*x) for x in df.dtypes)), F.lit(" |"))


def markdown_table(df: DataFrame) -> str:
    """A Markdown table as one text, whole: for results of aggregates. report_lines() takes any number of rows."""
    rows = df.select(_table_row(df).alias("line")).toLocalIterator()
    return "\n".join([*_table_head(df), *(r[0] for r in rows)])


#: A part of a report: its rows, and the order they come in (None where there is one row).
Part = tuple[DataFrame, list | None]


def _placed(df: DataFrame, order: list | None) -> tuple[DataFrame, Column]:
    return (df, F.lit(0).cast("bigint")) if order is None else (_splits.ranked(df, order), F.col("rank"))


def report_lines(title: str, parts: dict[str, Part]) -> DataFrame:
    """(section, place, value): a report of Markdown tables by line, in the order of section and place.

    Rows are formatted where they are and ranked by ranges, so a table may have any number of them.
    """
    heads, out = [(0, 0, f"# {title}")], None
    for k, (name, (df, order)) in enumerate(parts.items(), 1):
        heads += [(k, i, x) for i, x in enumerate(["", f"## {name}", "", *_table_head(df)])]
        rows, place = _placed(df, order)
        lines = rows.select(F.lit(k).alias("section"), (place + 5).cast("bigint").alias("place"), _table_row(df).alias("value"))
        out = lines if out is None else out.unionByName(lines)
    first = df.sparkSession.createDataFrame(heads, "section int, place bigint, value string")
    return first.unionByName(out)


def report_rows(parts: dict[str, Part]) -> DataFrame:
    """(section, place, row): the same tables as JSON, an object for each row."""
    out = None
    for name, (df, order) in parts.items():
        rows, place = _placed(df, order)
        json = rows.select(F.lit(name).alias("section"), place.alias("place"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = json if out is None else out.unionByName(json)
    return out


def write_report(path: str, title: str, parts: dict[str, Part]) -> None:
    """A report in a folder: `page`, text files whose order is that of its lines, and `rows`, its JSON by section."""
    order = ("section", "place")
    report_lines(title, parts).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("errorifexists").text(f"{path}/page")
    report_rows(parts).repartitionByRange(*order).sortWithinPartitions(*order).select("section", F.col("row").alias("value")).write.partitionBy("section").mode("errorifexists").text(f"{path}/rows")


def failure_lines(counts: DataFrame, worst: DataFrame, regressions: DataFrame | None = None, new_failures: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """(section, place, key, value): the failure report by line, with a count and every item of each section.

    counts is a small table of aggregates. Of the others the first column is the id, the rest is told behind
    it; a section that is None was not compared. Lines in the order of section, place, key and value are the report.
    """
    spark = counts.sparkSession
    schema = "section int, place int, key string, value string"
    heads, out = [], None
    parts = (("Best", best), ("Worst", worst), ("Regressions", regressions), ("New failures", new_failures))
    table = ["## Counts", "", *markdown_table(counts).split("\n")]
    # One row for each line of the table and head of a section.
    heads += [(0, i, "", x) for i, x in enumerate(table)]
    for k, (title, df) in enumerate(parts, 1):
        heads += [(k, 0, "", ""), (k, 1, "", f"## {title}"), (k, 2, "", "")]
        if df is None:
            heads.append((k, 3, "", "No comparison run provided."))
            continue
        first, *rest = (_cell(*x) for x in df.dtypes)
        line = F.concat(F.lit("- `"), first, F.lit("`"), *([F.lit(" — "), F.concat_ws(", ", *rest)] if rest else []))
        rows = df.select(F.lit(k).alias("section"), F.lit(5).alias("place"), first.alias("key"), line.alias("value"))
        count = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("section"), F.lit(3).alias("place"), F.lit("").alias("key"), F.concat(F.lit("Count: "), "n").alias("value"))
        heads.append((k, 4, "", ""))
        both = rows.unionByName(count)
        out = both if out is None else out.unionByName(both)
    return spark.createDataFrame(heads, schema).unionByName(out)


_REPORT_ORDER = ("section", "place", "key", "value")


def failures_report(counts: DataFrame, worst: DataFrame, regressions: DataFrame | None = None, new_failures: DataFrame | None = None, best: DataFrame | None = None) -> str:
    """The failure report as one text, whole: it is as long as its items are many; write_failures() takes any number."""
    lines = failure_lines(counts, worst, regressions, new_failures, best).orderBy(*_REPORT_ORDER)
    return "\n".join(r["value"] for r in lines.select("value").toLocalIterator()) + "\n"


def write_failures(path: str, counts: DataFrame, worst: DataFrame, regressions: DataFrame | None = None, new_failures: DataFrame | None = None, best: DataFrame | None = None) -> None:
    """The failure report as text files in a folder, whose order is that of the report."""
    lines = failure_lines(counts, worst, regressions, new_failures, best)
    lines.repartitionByRange(*_REPORT_ORDER).sortWithinPartitions(*_REPORT_ORDER).select("value").write.mode("errorifexists").text(path)


def profile_parts(lengths: DataFrame, limits: DataFrame, domains: DataFrame, longest: DataFrame, stats: DataFrame, files: DataFrame) -> dict[str, Part]:
    """The parts of a record set's profile: length statistics, records over limits, domains by size, the longest records,
    blueprint statistics and the histogram of their files. Domains and file counts may be any number."""
    size = F.col(domains.columns[1]).desc()
    return {
        "Lengths": (lengths, None), "Over the limit": (limits, [F.col("threshold")]), "Domains": (domains, [size, F.col(domains.columns[0])]),
        "Longest": (longest, [F.col(longest.columns[1]).desc(), F.col(longest.columns[0])]), "Blueprints": (stats, None), "Files a blueprint": (files, [F.col(files.columns[0])]),
    }


def eda_report(*tables: DataFrame) -> tuple[str, dict]:
    """The profile of profile_parts()'s tables as one Markdown text and as a dictionary for JSON, both whole; write_report() takes any number of rows."""
    import json

    parts = profile_parts(*tables)
    lines, data = report_lines("Profile", parts).orderBy("section", "place").select("value").toLocalIterator(), {name: [] for name in parts}
    text = "\n".join(r[0] for r in lines) + "\n"
    for r in report_rows(parts).orderBy("section", "place").toLocalIterator():
        data[r["section"]].append(json.loads(r["row"]))
    return text, data


def run_readme(summary: DataFrame, *, model: str, default: str, split: str, mode: str, limit: int | None, full: int) -> tuple[str, dict]:
    """The page of a run and its scores: what was run, whether it is only a smoke test, and the score's layers."""
    scores = summary.first().asDict()
    smoke = is_smoke(model, default, limit, full)
    head = [f"# Run of {model}{' (SMOKE TEST)' if smoke else ''}", "", f"- split: {split}", f"- mode: {mode}", f"- records: {scores['n']} of {full}", ""]
    return "\n".join([*head, markdown_table(summary)]) + "\n", scores | {"model": model, "split": split, "mode": mode, "smoke": smoke}


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file by whatever file system holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def comparison_lines(result: DataFrame) -> DataFrame:
    """(place, value): the comparison of two runs as a list of its figures, by line; result has one row."""
    figures = F.array(F.lit("# Comparison"), F.lit(""), *(F.concat(F.lit(f"- {c}: "), _cell(c, kind)) for c, kind in result.dtypes))
    return result.select(F.posexplode(figures).alias("place", "value"))


def comparison_report(result: DataFrame) -> str:
    """The comparison of two runs as one text."""
    return "\n".join(r["value"] for r in comparison_lines(result).orderBy("place").collect()) + "\n"


def is_smoke(model: str, default: str, limit: int | None, full: int) -> bool:
    """Whether a run is only a smoke test: another model, or fewer records than the split has."""
    return model != default or limit is not None and limit < full
