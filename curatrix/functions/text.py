"""Column functions over text: tokens, fences, names, paths, licences, markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as white space at the ends of a text (the ASCII part and the separators of Unicode).
SPACE = "[\\s\\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"

#: Licences that may be used, and file names they are looked for in.
PERMISSIVE = ("mit", "apache-2.0", "bsd", "cc0", "unlicense")
SELECTOR_LICENCE_FILES = ("LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "LICENCE.md")
CONVERTER_LICENCE_FILES = ("LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "COPYING")

#: Names that no bundle may take, and the pattern of valid ones.
RESERVED_NAMES = ("claude", "anthropic")
NAME_PATTERN = "^[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?$"

#: Headings of the sections that say when a bundle is for use and when not.
WHEN_USE = ("when to use", "use cases?", "triggers?", "activat")
WHEN_NOT = ("when not to use", "don'?t use", "limitations?", "out of scope", "not suitable", "avoid when")


def strip(col: Column) -> Column:
    """White space off both ends, line breaks and Unicode spaces included."""
    return F.regexp_replace(F.regexp_replace(col, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def tokens(col: Column) -> Column:
    """Runs of ASCII letters and digits in the lower-cased text."""
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), 0)


def token_set(col: Column) -> Column:
    return F.array_distinct(tokens(col))


def once(col: Column, use) -> Column:
    """use(col), with col computed once however often use takes it: a transform over one element binds it."""
    return F.get(F.transform(F.array(col), use), 0)


_CONTROLS = "[\\x00-\\x1F\\x7F-\\xA0\\xAD]"


def quoted(col: Column) -> Column:
    """Text in quotes as Python shows it: single ones unless only they occur inside, controls and backslashes escaped."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for c, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        out = F.replace(out, F.lit(c), F.lit("\\" + name))

    def plain(x):
        each = F.transform(F.regexp_extract_all(x, F.lit("(?s)."), 0), lambda c: F.when(c.rlike(_CONTROLS), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c))
        return F.when(x.rlike(_CONTROLS), F.array_join(each, "")).otherwise(x)

    def in_quotes(x):
        double = x.contains("'") & ~x.contains('"')
        return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return once(once(out, plain), in_quotes)


def strip_fences(col: Column) -> Column:
    """Code fences off, wherever a line begins or ends with one, then white space off the ends."""
    return strip(F.regexp_replace(col, f"(?md)^```(?:json)?{SPACE}*|{SPACE}*```$", ""))


def weak_unfence(col: Column) -> Column:
    """Back-ticks off both ends and one leading `json`."""
    return F.regexp_replace(F.btrim(strip(col), F.lit("`")), "^json", "")


def valid_name(col: Column) -> Column:
    """Lower-case words joined by single hyphens, up to 64 characters; one final line feed passes."""
    return F.coalesce(col.rlike("(?d)" + NAME_PATTERN) & ~col.contains("--"), F.lit(False))


def normal_name(col: Column) -> Column:
    """Lower case, `_` and spaces to hyphens, runs of hyphens to one, none at the ends."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(col), "_ ", "--"), "-+", "-"), F.lit("-"))


def repo_slug(col: Column) -> Column:
    """The first underscore becomes a slash."""
    return F.regexp_replace(col, "^([^_]*)_", "$1/")


def record_id(repo: Column, name: Column) -> Column:
    return F.concat_ws("__", repo, name)


def unsafe_path(col: Column) -> Column:
    """Holds `..` anywhere or begins with a slash."""
    return F.coalesce(col.contains("..") | col.startswith("/"), F.lit(False))


def licence(col: Column) -> Column:
    """A guess from the first 400 characters: the substrings decide, so `limited` is taken for mit."""
    head = F.lower(F.substring(col, 1, 400))
    out = F.when(col.isNull(), "unknown").when(head.contains("apache license") & head.contains("version 2.0"), "apache-2.0")
    for name in ("mit", "bsd", "cc0", "unlicense"):
        out = out.when(head.contains(name), name)
    return out.otherwise("present (unparsed)")


def effective_licence(own: Column, repo: Column) -> Column:
    """The item's licence if permissive, else the repository's if permissive, else null."""
    return F.coalesce(F.when(own.isin(*PERMISSIVE), own), F.when(repo.isin(*PERMISSIVE), repo))


def first_found_licence(own: Column, repo: Column) -> Column:
    """The first licence file found decides, whether permissive or not."""
    return F.coalesce(own, repo, F.lit("unknown"))


def front_matter(col: Column) -> Column:
    """The YAML block between the first two `---` lines, empty if there is none."""
    return F.regexp_extract(col, r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z", 1)


def body(col: Column) -> Column:
    """What follows the front matter, or the whole text."""
    return F.when(col.rlike(r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z"), F.regexp_extract(col, r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z", 2)).otherwise(col)


def front_matter_field(col: Column, name: str) -> Column:
    """A plain `name: value` line of the front matter, quotes off, null if absent; front_matter_values() reads YAML."""
    line = F.regexp_extract(front_matter(col), rf"(?m)^{name}:[ \t]*(.*)$", 1)
    return F.nullif(F.regexp_replace(strip(line), "^(['\"])(.*)\\1$", "$2"), F.lit(""))


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType())]))
def _yaml_values(block):
    import pandas as pd

    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading front matter takes the yaml library") from e

    def one(text):
        try:
            found = yaml.safe_load(text or "")
        except (yaml.YAMLError, ValueError):
            found = None
        found = found if isinstance(found, dict) else {}
        return tuple(str(found.get(k, "")).strip() for k in ("name", "description"))

    return pd.DataFrame([one(x) for x in block], columns=["name", "description"])


def flat_settings(config: dict, above: str = "") -> dict[str, object]:
    """Dotted keys; lists stay whole."""
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flat_settings(v, f"{above}{k}.") if isinstance(v, dict) else {f"{above}{k}": v}
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def yaml_settings(texts):
    """A YAML mapping's settings by dotted key, as text; null for what is no mapping or no YAML."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading settings takes the yaml library") from e

    def one(x):
        try:
            found = yaml.safe_load(x or "")
        except (yaml.YAMLError, ValueError):
            return None
        return {k: str(v) for k, v in flat_settings(found).items()} if isinstance(found, dict) else None

    return texts.map(one)


def front_matter_values(col: Column) -> Column:
    """A struct of name and description as YAML has them, as text without white space around; empty where the block,
    the mapping or the key is absent. A block that is no YAML counts as absent."""
    return _yaml_values(front_matter(col))


def is_stub(col: Column) -> Column:
    """No text, or one that says the bundle has moved."""
    low = F.lower(col)
    head = F.regexp_extract(low, r"(?s)^---\s*\n(.*?)\n---", 1)
    said = low.rlike(r"status:\s*moved") | low.contains("signpost") | low.contains("no longer developed here") | head.contains("deprecated compatibility entry")
    return col.isNull() | F.coalesce(said, F.lit(False))


def first_paragraph(col: Column) -> Column:
    """The first paragraph that is no heading or rule, on one line, 500 characters at most."""
    chunks = F.transform(F.split(col, r"\n\s*\n"), strip)
    good = F.filter(chunks, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("---"))
    return F.coalesce(F.substring(F.regexp_replace(F.get(good, 0), r"\s+", " "), 1, 500), F.lit(""))


def section_items(col: Column, patterns: tuple[str, ...]) -> Column:
    """Items and plain lines under the first heading that matches, up to the next heading."""
    none = F.array().cast("array<string>")
    title = lambda x: F.lower(strip(F.regexp_replace(x, "^#+", "")))

    def inside(lines, at):
        rest = F.slice(lines, at + 1, F.size(lines))
        stop = F.array_position(F.transform(rest, lambda x: x.startswith("#")), True).cast("int")
        kept = once(stop, lambda n: F.when(n > 0, F.slice(rest, 1, n - 1)).otherwise(rest))
        item = F.transform(kept, lambda x: strip(F.regexp_replace(x, r"^(?:[-*]\s+|\d+[.)]\s+)", "")))
        return F.when(at > 0, F.filter(item, lambda x: x != "")).otherwise(none)

    head = lambda x: F.when(x.startswith("#"), title(x).rlike("|".join(patterns))).otherwise(False)
    return once(F.transform(F.split(col, "\n"), strip), lambda lines: once(F.array_position(F.transform(lines, head), True).cast("int"), lambda at: inside(lines, at)))


#: What the files of a bundle are for, and what is said of one that isn't text.
PURPOSES = {
    "SKILL.md": "Main skill definition: YAML frontmatter plus Markdown instructions.",
    "scripts": "Executable helper script used by the skill.",
    "references": "Reference documentation loaded on demand.",
    "assets": "Static asset or template bundled with the skill.",
    "": "Supporting file bundled with the skill.",
}
BINARY = " (binary — content omitted)"


def file_purpose(path: Column) -> Column:
    """What a file of a bundle is for, by its name and top folder."""
    top = F.get(F.split(path, "/"), 0)
    return (
        F.when(F.element_at(F.split(path, "/"), -1) == "SKILL.md", PURPOSES["SKILL.md"])
        .when(top == "scripts", PURPOSES["scripts"])
        .when(top == "references", PURPOSES["references"])
        .when(top == "assets", PURPOSES["assets"])
        .otherwise(PURPOSES[""])
    )


def capped(col: Column, chars: int = 200_000) -> Column:
    """At most so many characters, with a mark where text was cut."""
    return F.when(F.length(col) > chars, F.concat(F.substring(col, 1, chars), F.lit("\n…[truncated]"))).otherwise(col)


def is_binary(content: Column) -> Column:
    """A NUL among the first 4096 bytes; unreadable content counts as binary."""
    return F.coalesce(F.contains(F.substring(content, 1, 4096), F.lit(bytearray(b"\x00"))), F.lit(True))


def decoded(content: Column) -> Column:
    """UTF-8 with replacement characters for what is malformed."""
    return F.make_valid_utf8(content.cast("string"))


def seeded(seed: int, key: Column) -> Column:
    """A reproducible order that doesn't depend on partitions: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def user_content(instruction: Column, context: Column) -> Column:
    """The instruction, with the context in tags where there is one."""
    return F.when(F.coalesce(context, F.lit("")) == "", instruction).otherwise(F.concat(instruction, F.lit("\n\n<context>\n"), context, F.lit("\n</context>")))


def chatml(messages: Column) -> Column:
    """An array of (role, content) in ChatML."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))
