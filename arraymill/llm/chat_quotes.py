"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` before its text. Adjacent lines of one level form a
passage. Quoted passages are normalised and hashed, as are the lines, sentences, paragraphs and whole
own text of every message, and each quoted passage is linked to the latest earlier message of its
conversation that says it. A passage that no message says as a whole, as when it has two lines of a
paragraph, is taken apart: of the latest earlier messages that say any of its lines or sentences it is
linked to the one that says most of it, by characters of its lines or of its sentences, ``COVER`` at
least, the latest of several.

A message replies to the one that its shallowest linked quote comes from (the last such quote), else
to the turn before, if there is one. The first reply to a message goes on with its thread, any further
one opens a thread of its own; by (thread, turn) each message follows the one it replies to, and
position counts them so within a conversation. Quoted lines, linked or not, leave the text.

Defined results: a null text is an empty one; a passage of blanks or of quote marks alone is nothing;
rows that repeat a conversation and turn are one message, with all their links, and each of them is
returned; a null conversation or turn takes no part in linking: such a message is a thread by itself
(thread, position and reply_to null). A text of any length is one row's work, linear in its lines.
Columns besides don't matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import ranked
from .shared import drop_table, text_key, text_or_empty, written

_MARKS = r"^\s*((?:>\s?)*)"
#: Share of a quoted passage that a message must say to be its origin.
COVER = 0.5


def normalised(text: Column) -> Column:
    """Lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, text_key, at, level, lines``: runs of lines of one quote level, marks removed."""
    lines = F.split(text_or_empty(), "\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", ""))
    body = lambda x: F.regexp_replace(x, _MARKS, "")
    parsed = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.when(level(x) > 0, body(x)).otherwise(x).alias("line")))
    rows = messages.select("conv_id", "turn", text_key().alias("text_key"), parsed.alias("parsed"))
    levels, bodies = F.transform("parsed", lambda p: p["level"]), F.transform("parsed", lambda p: p["line"])
    rows = rows.select("conv_id", "turn", "text_key", levels.alias("levels"), bodies.alias("bodies"))
    n = F.size("levels")
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)))
    rows = rows.withColumn("begins", begins)
    end = lambda at: F.coalesce(F.get("begins", at + 1), n)
    found = F.transform("begins", lambda i, at: F.struct(at.alias("at"), F.get("levels", i).alias("level"), F.slice("bodies", i + 1, end(at) - i).alias("lines")))
    return rows.select("conv_id", "turn", "text_key", F.inline(found))


def units(lines: Column, paragraphs: Column) -> tuple[Column, Column]:
    """A passage's normalised lines and sentences."""
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(normalised(p), "(?<=[.!?]) ", -1)))
    return F.transform(lines, normalised), sentences


def best_covering(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """``conv_id, turn, text_key, at, covering`` of quoted passages that some earlier message says in parts."""
    quote = ["conv_id", "turn", "text_key", "at"]
    by_kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(u).alias("own")) for k, u in enumerate(units(F.col("lines"), F.col("paragraphs")))])
    parts = quotes.select(*quote, F.inline(by_kind)).select(*quote, "kind", F.explode("own").alias("unit")).filter("unit <> ''")
    parts = parts.select(*quote, "kind", F.xxhash64("unit").alias("h"), F.length("unit").alias("chars"))
    totals = parts.groupBy(*quote, "kind").agg(F.sum("chars").alias("total"))
    candidates = latest_earlier(parts.select(*quote, "h").distinct(), said, quote[2:]).filter("origin is not null").select(*quote, "origin").distinct()
    there = said.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("h").alias("said"))
    met = parts.join(candidates, quote).join(there, (F.col("conv_id") == F.col("c")) & (F.col("origin") == F.col("t")) & (F.col("h") == F.col("said")))
    share = met.groupBy(*quote, "kind", "origin").agg(F.sum("chars").alias("met")).join(totals, [*quote, "kind"]).withColumn("share", F.round(F.col("met") / F.col("total"), 9))
    return share.filter(F.col("share") >= COVER).groupBy(*quote).agg(F.max(F.struct("share", "origin"))["origin"].alias("covering"))


def latest_earlier(quotes: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """The quotes, by ``conv_id, turn, h``, with the ``origin`` that last said the same before, in one ordered pass."""
    none = lambda c: F.lit(None).cast(quotes.schema[c].dataType).alias(c)
    marks = said.select("conv_id", "h", "turn", F.col("turn").alias("origin"), *map(none, keys), F.lit(False).alias("quote"))
    marks = marks.unionByName(quotes.select("conv_id", "h", "turn", none("turn").alias("origin"), *keys, F.lit(True).alias("quote")))
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("origin", F.max("origin").over(earlier)).filter("quote").drop("quote")


def linked(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, quotes, linked`` of each distinct message."""
    rows = messages.filter("conv_id is not null and turn is not null")
    text = F.array_join("lines", "\n")
    parts = passages(rows).withColumn("paragraphs", F.split(text, r"\n\s*\n", -1)).withColumn("whole", normalised(text))
    parts, path = written(parts, "chat-passages")
    nodes = parts.select("conv_id", "turn").distinct()
    lines, sentences = units(F.col("lines"), F.col("paragraphs"))
    own = F.array_union(F.array_union(lines, sentences), F.array_union(F.transform("paragraphs", normalised), F.array("whole")))
    said = parts.filter("level = 0").select("conv_id", "turn", F.explode(own).alias("said"))
    said, said_path = written(said.filter("said <> ''").select("conv_id", "turn", F.xxhash64("said").alias("h")).distinct(), "chat-said")
    quotes = parts.filter("level > 0 and whole <> ''").select("conv_id", "turn", "text_key", "level", "at", F.xxhash64("whole").alias("h")).distinct()
    met, met_path = written(latest_earlier(quotes, said, ["text_key", "level", "at"]), "chat-quotes")
    quote = ["conv_id", "turn", "text_key", "at"]
    others = parts.join(met.filter("origin is null").select(*quote), quote, "left_semi").dropDuplicates(quote)
    met = met.join(best_covering(others, said), quote, "left").withColumn("origin", F.coalesce("origin", "covering"))
    by_node = met.groupBy("conv_id", "turn").agg(F.count("*").alias("quotes"), F.count("origin").alias("linked"), F.min(F.when(F.col("origin").isNotNull(), F.struct(F.col("level"), (-F.col("at")).alias("at"), (-F.col("origin")).alias("origin")))).alias("best"))
    by_node = by_node.select("conv_id", "turn", "quotes", "linked", (-F.col("best.origin")).alias("quoted"))
    before = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    out = nodes.join(by_node, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    out, _ = written(out.select("conv_id", "turn", F.coalesce("quoted", "before").alias("reply_to"), F.coalesce("quotes", zero).alias("quotes"), F.coalesce("linked", zero).alias("linked")), "chat-links")
    for own in (path, said_path, met_path):
        drop_table(messages.sparkSession, own)
    return out


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, thread``: the turn that opens each message's thread, by pointer doubling."""
    first = links.filter("reply_to is not null").groupBy("conv_id", "reply_to").agg(F.min("turn").alias("turn")).select("conv_id", "turn", F.col("reply_to").alias("up"))
    start = links.select("conv_id", "turn").join(first, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("up", "turn").alias("thread"), F.col("up").isNull().alias("settled"))
    now, path = written(start, "chat-threads")
    while now.filter("not settled").limit(1).count():
        # a message settles once it points to one that has; settled ones rest
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"), F.col("settled").alias("there"))
        moved = now.filter("not settled").join(up, ["conv_id", "thread"]).select("conv_id", "turn", F.col("up").alias("thread"), F.col("there").alias("settled"))
        following, new_path = written(now.filter("settled").unionByName(moved), "chat-threads")
        drop_table(now.sparkSession, path)
        now, path = following, new_path
    return now.drop("settled")


def conversations(messages: DataFrame) -> DataFrame:
    """The messages: ``conv_id, thread, turn, role, reply_to, quotes, linked, text, position``.

    text has no quoted lines; by position the messages of a conversation are in reply order.
    """
    links = linked(messages)
    known, _ = written(threads(links), "chat-threads")
    placed = ranked(known, "conv_id", "thread", "turn", name="place")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    known = links.join(placed.join(first, "conv_id").withColumn("position", F.col("place") - F.col("first")).drop("place", "first"), ["conv_id", "turn"])
    lines = F.split(text_or_empty(), "\n", -1)
    own = F.filter(lines, lambda x: ~x.rlike(r"^\s*>"))
    rows = messages.select("conv_id", "turn", "role", F.trim(F.array_join(own, "\n")).alias("text")).withColumn("text", F.regexp_replace("text", r"^\n+|\n+$", ""))
    zero = F.lit(0).cast("long")
    out = rows.join(known, ["conv_id", "turn"], "left").select("conv_id", "thread", "turn", "role", "reply_to", F.coalesce("quotes", zero).alias("quotes"), F.coalesce("linked", zero).alias("linked"), "text", "position")
    return out
