"""Quotation linking: conversations in reply order, without the quotes, in DataFrame operations only.

Lines that begin with one or more ``>`` quote an earlier message, at as many
levels. Quoted passages are normalised and hashed, and joined to the message of
the conversation that first said them; that message is what the quoting one answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, store

# No group here repeats with a way back into it: the regular expressions of the JVM would recurse once for each repetition.
MARKS = r"^(?:[ \t]{0,3}+>)++"
# A line that announces a quote has one of these words and ends in a colon, such as "On Monday Ann wrote:".
# Fixed words: English, German, French, Spanish, Italian, Dutch.
ANNOUNCES = r"(?i)\b(?:wrote|schrieb|a écrit|escribió|ha scritto|schreef)\b"
BREAK = r"\n[ \t\n]*\n"


def parsed_lines(text: Column) -> Column:
    """Lines as (level, body): how many quote marks a line begins with, and what is behind them."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, f"({MARKS})", 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("body"))

    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1), line)


def announces(body: Column) -> Column:
    return F.endswith(F.rtrim(body, F.lit(" \t")), F.lit(":")) & body.rlike(ANNOUNCES)


def own_text(text: Column, lines: Column) -> Column:
    """What a message itself says: a text without quotes as it is, else its unquoted lines, less those that announce a quote."""
    def stays(x: Column, i: Column) -> Column:
        then = F.get(lines, i + 1)["level"]
        return F.when((x["level"] == 0) & ~((F.coalesce(then, F.lit(0)) > 0) & announces(x["body"])), x["body"])

    said = F.array_join(F.filter(F.transform(lines, stays), lambda b: b.isNotNull()), "\n")
    tidy = F.trim(F.regexp_replace(said, r"\n[ \t]*\n[ \t\n]*\n", "\n\n"), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.exists(lines, lambda x: x["level"] > 0), tidy).otherwise(F.coalesce(text, F.lit("")))


def normal(passage: Column) -> Column:
    """A passage as it is compared: lower case, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def passages(text: Column) -> Column:
    """The paragraphs of a text and the lines of those with several, normalised, each once, none empty."""
    paragraphs = F.split(text, BREAK, -1)
    every = F.concat(paragraphs, F.flatten(F.transform(paragraphs, lambda p: F.split(p, "\n", -1))))
    return F.array_distinct(F.filter(F.transform(every, normal), lambda p: p != ""))


def quoted(lines: Column) -> Column:
    """(level, passage) of everything quoted; lines of other levels part passages."""
    levels = F.array_distinct(F.filter(F.transform(lines, lambda x: x["level"]), lambda v: v > 0))

    def at(level: Column) -> Column:
        text = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["body"]).otherwise("")), "\n")
        return F.transform(passages(text), lambda p: F.struct(level.alias("level"), p.alias("passage")))

    return F.flatten(F.transform(levels, at))


def linked(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Every message without its quotes, with what it answers.

    Columns: conv_id, turn, role, text, n_quotes (distinct quoted passages and
    lines), n_linked (those found in an earlier message), reply_to (the turn it
    answers), thread (the first turn of its chain of answers), depth (answers from
    there) and position (its place in the thread, from 0, each message behind
    what it answers): conv_id, thread and position order a conversation by
    replies. A message whose rows repeat has one position.

    A passage belongs to the earliest turn of its conversation that says it
    unquoted. The turn answered is the one whose passages are quoted at the
    lowest level, then the one with the most quoted characters, then the latest.
    A null text is empty. Messages without conv_id or turn link to nothing.
    Rows of one conversation and turn are one message in parts: each keeps its
    row and text, and they answer together; equal rows count twice nowhere but
    in the rows. Other columns are ignored. Only hashes are joined, with one row
    per conversation and passage on the side of what was said, so a passage that
    many repeat is joined once per quoting message; no conversation is gathered.
    """
    base = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("raw"))
    lines = base.withColumn("lines", parsed_lines(F.col("raw")))
    cut = lines.select("conv_id", "turn", "role", own_text(F.col("raw"), F.col("lines")).alias("text"), quoted(F.col("lines")).alias("quotes"))
    placed = cut.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = store(
        placed.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q"))
        .select("conv_id", "turn", "q.level", F.sha2("q.passage", 256).alias("hash"), F.length("q.passage").alias("chars")).distinct()
    )
    parents = roots = None
    if not quotes.isEmpty():
        quoting = quotes.select("conv_id").distinct()
        said = store(
            placed.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("passage"))
            .groupBy("conv_id", F.sha2("passage", 256).alias("hash")).agg(F.min("turn").alias("said"))
        )
        hits = store(quotes.join(said, ["conv_id", "hash"]).where("said < turn"))
        best = F.max(F.struct((-F.col("level")).alias("near"), "chars", "said")).alias("best")
        answers = (
            hits.groupBy("conv_id", "turn", "level", "said").agg(F.sum("chars").alias("chars"))
            .groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.said").alias("reply_to"))
        )
        found = hits.groupBy("conv_id", "turn").agg(F.countDistinct("hash").alias("n_linked"))
        parents = store(answers.join(found, ["conv_id", "turn"]))
        roots = chains(parents)
    counted = F.size(F.array_distinct(F.transform("quotes", lambda q: q["passage"]))).cast("long").alias("n_quotes")
    out = cut.select("conv_id", "turn", "role", "text", counted)
    if parents is None:
        return out.select("*", F.lit(0).cast("long").alias("n_linked"), F.lit(None).cast("long").alias("reply_to"),
                          F.col("turn").cast("long").alias("thread"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("position"))
    # A message answers an earlier turn, so the order of turns puts it behind that; the thread's first is not in this table.
    info = ranked(store(parents.join(roots, ["conv_id", "turn"])), ["conv_id", "thread"], ["turn"])
    return out.join(info, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("reply_to").cast("long").alias("reply_to"), F.coalesce("thread", "turn").cast("long").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce(F.col("pos") + 1, F.lit(0)).cast("long").alias("position"))


def chains(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of every answer, by doubling the reach of its pointer each round.

    A turn answers an earlier one only, so there are no cycles, and rounds number
    the logarithm of the longest chain.
    """
    now = store(parents.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = store(now.join(up, ["conv_id", "thread"], "left"))
        done = step.where("next IS NOT NULL").limit(1).isEmpty()
        now = step.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if done:
            return now
        now = store(now)
