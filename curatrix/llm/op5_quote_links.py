"""Chat formatting by quotation linking, with DataFrame functions alone.

Lines that begin with `>` marks are quotes; the number of marks is their level. A passage is a run of
lines of one level. Normalised passages are hashed and joined to the first message of the same
conversation that said them: as its whole text, a paragraph or a line. A passage that nobody said as
a whole is looked up line by line: a line of 20 characters or more links by itself, shorter ones
link where all lines of the passage were first said by one message. The message that a reply's outermost quotes come from is what it
replies to; chains of replies are followed by pointer doubling to the message that opened the thread.
Conversations then read thread by thread, replies after what they answer, without the quotes.

A conversation may be of any size: no step gathers one. Originals are a minimum by (conversation,
hash), joins may be split where a key is hot, and positions come from a global sort by range whose
partition sizes are added up.

Defined results
- a null text is empty; empty messages stay, with empty text;
- rows that share conversation and turn are one message to those that quote them, and keep their own
  texts and places; rows equal in everything take neighbouring places;
- null ids and turns come first and stay null; a quote of something nobody said, or said only later,
  stays unlinked, and is still taken out of the text;
- an empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, NULL_ID, by_place, staged, table

MIN_LINE_CHARS = 20
MAX_DOUBLINGS = 64


def normalised(col):
    return F.btrim(F.lower(F.regexp_replace(col, r"[ \t\n\x0B\f\r]+", " ")))


def _hash(col):
    return F.unhex(F.md5(F.encode(col, "UTF-8")))


def parsed(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, said, quotes): the text without quotes, and the quoted passages as (level, text)."""
    flat, place = by_place(messages)
    m = flat.select(
        F.coalesce(F.col(place[conv_id]).cast("bigint"), F.lit(NULL_ID)).alias("conv"),
        F.coalesce(F.col(place[turn]).cast("bigint"), F.lit(NULL_ID)).alias("turn"),
        F.col(place[role]).alias("role"),
        F.split(F.coalesce(F.col(place[text]), F.lit("")), "\n", -1).alias("raw"),
    )
    mark = lambda x: F.regexp_extract(x, r"^(?:[ \t]*>)+", 0)
    m = m.withColumn("at", F.transform("raw", lambda x: F.length(mark(x))))
    m = m.withColumn("level", F.transform("raw", lambda x: F.length(F.regexp_replace(mark(x), "[^>]", ""))))
    m = m.withColumn("n", F.size("raw"))
    level = lambda i: F.get(F.col("level"), i)
    # Runs of one level, by where they start and end; without quotes nothing of this is computed.
    places = F.when(F.exists("level", lambda x: x > 0), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (level(i) > 0) & ((i == 0) | (level(i) != level(i - 1))))
    ends = F.filter(places, lambda i: (level(i) > 0) & ((i == F.col("n") - 1) | (level(i) != level(i + 1))))
    m = m.withColumn("runs", F.arrays_zip(starts.alias("s"), ends.alias("e")))
    content = lambda i: F.substring(F.get("raw", i), F.get("at", i) + 1, F.length(F.get("raw", i)))
    quotes = F.transform("runs", lambda r: F.struct(level(r["s"]).alias("level"), F.array_join(F.transform(F.sequence(r["s"], r["e"]), content), "\n").alias("text")))
    said = F.array_join(F.filter("raw", lambda x: ~F.ltrim(x, F.lit(" \t")).startswith(">")), "\n")
    return m.select("conv", "turn", "role", F.btrim(said, F.lit(ASCII_SPACE)).alias("said"), quotes.alias("quotes"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked) of every message that quotes an earlier one. messages as parsed()."""
    units = F.concat(F.array("said"), F.split("said", "\n[ \t]*\n"), F.split("said", "\n"))
    said = messages.select("conv", "turn", F.explode(F.array_distinct(F.transform(units, normalised))).alias("unit")).where("unit <> ''")
    quoted = messages.where(F.size("quotes") > 0).select("conv", "turn", F.posexplode("quotes").alias("i", "q"))
    quoted = staged(quoted.select("conv", "turn", "i", F.col("q.level").alias("level"), F.col("q.text").alias("text"), normalised("q.text").alias("unit")).where("unit <> ''"), "quotes")
    # Only conversations with quotes can have links.
    asked = quoted.select("conv").distinct()
    origin = said.join(asked, "conv", "left_semi").groupBy("conv", _hash("unit").alias("h")).agg(F.min("turn").alias("source"))
    origin = staged(origin, "origins")

    def found(q):
        return q.withColumn("h", _hash("unit")).join(origin, ["conv", "h"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))

    whole = staged(found(quoted), "quote-links")
    # Messages may share conversation and turn, so a passage is told by its text too.
    lines = whole.where("source IS NULL").select("conv", "turn", "i", "level", F.col("h").alias("passage"), F.explode(F.transform(F.split("text", "\n"), normalised)).alias("unit")).where("unit <> ''")
    lines = staged(found(lines).withColumn("chars", F.length("unit")), "line-links")
    hits = whole.where("source IS NOT NULL").select("conv", "turn", "i", "level", "source", F.length("unit").alias("chars"))
    hits = hits.union(lines.where(F.col("source").isNotNull() & (F.col("chars") >= MIN_LINE_CHARS)).select("conv", "turn", "i", "level", "source", "chars"))
    short = lines.groupBy("conv", "turn", "i", "level", "passage").agg(F.sum(F.when(F.col("chars") < MIN_LINE_CHARS, F.col("chars"))).alias("chars"), F.min("source").alias("source"), F.max("source").alias("last"), F.bool_and(F.col("source").isNotNull()).alias("all"))
    hits = hits.union(short.where("all AND source = last AND chars IS NOT NULL").select("conv", "turn", "i", "level", "source", "chars"))
    by_source = hits.groupBy("conv", "turn", "source").agg(F.min("level").alias("level"), F.sum("chars").alias("chars"))
    best = F.min(F.struct("level", (-F.col("chars")).alias("chars"), (-F.col("source")).alias("source")))
    linked = hits.groupBy("conv", "turn").agg(F.countDistinct("i").alias("n_linked"))
    return by_source.groupBy("conv", "turn").agg(best.alias("best")).select("conv", "turn", (-F.col("best.source")).alias("reply_to")).join(linked, ["conv", "turn"])


def threads(links: DataFrame) -> DataFrame:
    """links with the turn that opened the thread and how many replies lead to it, by pointer doubling."""
    now = staged(links.select("conv", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("bigint").alias("depth")), "threads")
    for _ in range(MAX_DOUBLINGS):
        up = now.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        stepped = staged(now.join(up, ["conv", "thread"], "left"), "threads")
        if stepped.where("next IS NOT NULL").isEmpty():
            break
        now = stepped.select("conv", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return now


def link_quotes(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each message: (conv_id, position, turn, role, text, reply_to, thread, depth, n_quotes, n_linked, rendered)."""
    said = parsed(messages, conv_id, turn, role, text)
    links = staged(reply_links(said), "reply-links")
    where = links.join(threads(links), ["conv", "turn"])
    rows = said.join(where, ["conv", "turn"], "left").select(
        "conv", "turn", "role", F.col("said").alias("text"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.size("quotes").cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )
    order = ["conv", "thread", "turn", "role", "text"]
    # monotonically_increasing_id holds the partition above bit 33 and the place in it below.
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    spread = staged(spread.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), "reply-order")
    # One row for each partition.
    sizes = sorted((r[0], r[1]) for r in spread.groupBy("part").count().collect())
    base, starts = 0, []
    for part, n in sizes:
        starts.append((part, base))
        base += n
    starts = messages.sparkSession.createDataFrame(starts, "part bigint, base bigint")
    placed = spread.join(F.broadcast(starts), "part").withColumn("at", F.col("at") + F.col("base"))
    first = placed.groupBy("conv").agg(F.min("at").alias("first"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    rendered = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    return placed.join(first, "conv").select(
        null("conv").alias("conv_id"), (F.col("at") - F.col("first")).alias("position"), null("turn").alias("turn"), "role", "text",
        null("reply_to").alias("reply_to"), null("thread").alias("thread"), "depth", "n_quotes", "n_linked", rendered.alias("rendered"),
    )


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in reply order, without quotes."""
    return link_quotes(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, i, regexp_extract(ls[i], '^(?:[ \t]*>)+') AS mark, ls[i] AS line
  FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations))
), k AS (SELECT *, length(regexp_replace(mark, '[^>]', '', 'g')) AS level, substr(line, length(mark) + 1) AS content FROM l),
own AS (
  SELECT c.conv_id, c.turn, c.role, trim(coalesce(s, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS said
  FROM conversations c LEFT JOIN (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) AS s FROM k WHERE level = 0 GROUP BY 1, 2) o ON c.conv_id = o.conv_id AND c.turn = o.turn
), runs AS (SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run
            FROM (SELECT *, lag(level, 1, -1) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM k)),
q AS (SELECT conv_id, turn, run, min(level) AS level, string_agg(content, chr(10) ORDER BY i) AS t FROM runs WHERE level > 0 GROUP BY 1, 2, 3),
u AS (SELECT conv_id, min(turn) AS source, unit FROM (
        SELECT conv_id, turn, trim(lower(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS unit
        FROM (SELECT conv_id, turn, unnest(list_concat([said], regexp_split_to_array(said, '\n[ \t]*\n'), string_split(said, chr(10)))) AS x FROM own)) WHERE unit <> '' GROUP BY conv_id, unit),
qn AS (SELECT *, trim(lower(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS unit FROM q),
w AS (SELECT qn.*, source FROM qn LEFT JOIN u ON qn.conv_id = u.conv_id AND qn.unit = u.unit AND u.source < qn.turn WHERE qn.unit <> ''),
ql AS (SELECT conv_id, turn, run, level, trim(lower(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS unit FROM (SELECT *, unnest(string_split(t, chr(10))) AS x FROM w WHERE source IS NULL)),
lf AS (SELECT ql.conv_id, ql.turn, run, level, u.source, length(ql.unit) AS chars FROM ql LEFT JOIN u ON ql.conv_id = u.conv_id AND ql.unit = u.unit AND u.source < ql.turn WHERE ql.unit <> ''),
hits AS (SELECT conv_id, turn, run, level, source, length(unit) AS chars FROM w WHERE source IS NOT NULL
         UNION ALL SELECT conv_id, turn, run, level, source, chars FROM lf WHERE source IS NOT NULL AND chars >= 20
         UNION ALL SELECT conv_id, turn, run, level, min(source), sum(chars) FILTER (WHERE chars < 20) FROM lf GROUP BY conv_id, turn, run, level HAVING bool_and(source IS NOT NULL) AND min(source) = max(source) AND min(chars) < 20),
src AS (SELECT conv_id, turn, source, min(level) AS level, sum(chars) AS chars FROM hits GROUP BY 1, 2, 3),
best AS (SELECT conv_id, turn, source AS reply_to FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, source DESC) AS r FROM src) WHERE r = 1),
walk AS (SELECT conv_id, turn, reply_to AS thread, CAST(1 AS BIGINT) AS depth FROM best
         UNION ALL SELECT walk.conv_id, walk.turn, best.reply_to, depth + 1 FROM walk JOIN best ON walk.conv_id = best.conv_id AND walk.thread = best.turn),
ends AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM walk GROUP BY 1, 2),
nl AS (SELECT conv_id, turn, count(DISTINCT run) AS n FROM hits GROUP BY 1, 2),
nq AS (SELECT conv_id, turn, count(*) AS n FROM q GROUP BY 1, 2)
SELECT own.conv_id, row_number() OVER (PARTITION BY own.conv_id ORDER BY coalesce(ends.thread, own.turn), own.turn, role, said) - 1 AS position, own.turn, role, said AS text, reply_to,
       coalesce(ends.thread, own.turn) AS thread, coalesce(ends.depth, 0) AS depth, coalesce(nq.n, 0) AS n_quotes, coalesce(nl.n, 0) AS n_linked,
       '<|im_start|>' || coalesce(role, '') || chr(10) || said || '<|im_end|>' || chr(10) AS rendered
FROM own LEFT JOIN best ON own.conv_id = best.conv_id AND own.turn = best.turn LEFT JOIN ends ON own.conv_id = ends.conv_id AND own.turn = ends.turn
     LEFT JOIN nl ON own.conv_id = nl.conv_id AND own.turn = nl.turn LEFT JOIN nq ON own.conv_id = nq.conv_id AND own.turn = nq.turn
"""
