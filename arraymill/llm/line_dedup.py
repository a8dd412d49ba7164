"""Line deduplication by a suffix array over line ids, with DataFrame and SQL functions only.

The corpus is read as sequences of line ids, a document being one sequence. Lines that occur once
begin no repeat and go. The ids that are left are sorted and numbered, and prefix doubling ranks each
suffix by its first 1, 2, 4, ... lines: the pairs of ranks at both halves are sorted and numbered
anew, over ranges of the whole corpus; pairs that occur once go. Suffixes that share a rank are an
interval of the suffix array whose longest common prefix reaches as many lines; two ranks that
overlap give the interval of any number of lines. Doubling stops at the longest run that is asked for.

A repeated run counts from ``min_chars`` characters, newlines included. For every line the shortest
runs of that length that begin and that end there are looked up; any longer repeated run is the union
of such runs, each with an earlier occurrence where the longer one has. One aggregation finds the first
occurrence in each interval; all later occurrences' lines are deleted, adjacent ones together being
the maximal repeated run.

Line ids are two 64-bit hashes. Occurrences are ordered by doc_id (null first), then by a hash of the
text, then by line. Defined results: a null text is one empty line; rows with the same id and text
are one document and each gets its result; a text whose lines all go becomes empty, and only
``without_repeats`` can leave it out. A text of any length is one row's work. Columns besides keep
their values, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ranked
from .shared import drop_table, text_key, text_or_empty, written

MIN_CHARS = 50
_DOC = ("doc_id", "text_key")


def line_ids(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_key, chars, a, b`` of each distinct document that can hold a run: its lines' lengths and ids."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.split(text_or_empty(), "\n", -1).alias("lines"))
    rows = rows.select(
        *_DOC,
        F.transform("lines", lambda x: F.length(x) + 1).alias("chars"),
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
    )
    long = F.aggregate("chars", F.lit(0).cast("long"), lambda s, c: s + c) >= min_chars
    return rows.filter(long).dropDuplicates([*_DOC])


def shortest_runs(ids: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text_key, start, lines``: the shortest runs of min_chars that begin or end at each line."""
    # a run of m lines from the front of the cell, shortest with min_chars; 0 where none fits
    shortest = lambda cell: F.aggregate(
        cell,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("m")),
        lambda s, c: F.when(s["sum"] >= min_chars, s).otherwise(F.struct((s["sum"] + c).alias("sum"), (s["m"] + 1).alias("m"))),
        lambda s: F.when(s["sum"] >= min_chars, s["m"]).otherwise(0),
    )
    ahead = F.transform("chars", lambda c, i: F.when(c >= min_chars, 1).otherwise(shortest(F.slice("chars", i + 1, F.lit(min_chars)))))
    behind = F.transform("chars", lambda c, i: F.when(c >= min_chars, 1).otherwise(shortest(F.reverse(F.slice("chars", F.greatest(i - min_chars + 2, F.lit(1)), F.least(i + 1, F.lit(min_chars)))))))
    rows = ids.select(*_DOC, ahead.alias("ahead"), behind.alias("behind"))
    # a run that both ways give only once
    runs = F.array_distinct(
        F.concat(
            F.filter(F.transform("ahead", lambda m, i: F.struct(i.alias("start"), m.alias("lines"))), lambda r: r["lines"] > 0),
            F.filter(F.transform("behind", lambda m, i: F.struct((i - m + 1).alias("start"), m.alias("lines"))), lambda r: r["lines"] > 0),
        )
    )
    return rows.select(*_DOC, F.inline(runs))


def _met(left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
    """Rows of the left side with those of the right side of their document; its columns are ``d, k`` and others."""
    return left.join(right.hint("merge"), [left["doc_id"].eqNullSafe(right["d"]), left["text_key"] == right["k"], *more]).drop("d", "k")


def numbered(rows: DataFrame, *names: str) -> tuple[DataFrame, str]:
    """The rows whose names occur more than once, with the names' place in sorted order as ``rank``; and their path."""
    repeated = rows.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").select(*names)
    places = ranked(repeated, *names, name="rank")
    out = rows.join(places.hint("merge"), list(names)).select(*_DOC, "pos", "rank")
    return written(out, "line-ranks")


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, list[str]]:
    """``doc_id, text_key, start, lines, left, right``: the shortest runs in intervals of several suffixes, or
    perhaps of one, named by two ranks that overlap; and the paths of tables that hold them."""
    spark = docs.sparkSession
    ids, ids_at = written(line_ids(docs, min_chars), "line-ids")
    runs, runs_at = written(shortest_runs(ids, min_chars), "line-runs")
    most = runs.agg(F.max("lines")).first()[0] or 0
    lines = ids.select(*_DOC, F.posexplode(F.arrays_zip("a", "b")).alias("pos", "id")).select(*_DOC, "pos", "id.a", "id.b")
    now, path = numbered(lines, "a", "b")
    drop_table(spark, ids_at)
    found, paths, span = [], [runs_at], 1
    while True:
        paths.append(path)
        side = lambda at, rank, now=now: now.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("pos").alias(at), F.col("rank").alias(rank))
        own = runs.filter((F.col("lines") >= span) & (F.col("lines") < 2 * span))
        own = _met(own, side("p", "left"), F.col("start") == F.col("p")).drop("p")
        if span == 1:
            own = own.withColumn("right", F.col("left"))
        else:
            own = _met(own, side("p", "right"), F.col("start") + F.col("lines") - span == F.col("p")).drop("p")
        found.append(own)
        if most < 2 * span:
            break
        # ranks of twice as many lines only where some run is as long
        long = runs.filter(F.col("lines") >= 2 * span).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
        pairs = _met(_met(now, long).withColumnRenamed("rank", "left"), side("p", "right"), F.col("pos") + span == F.col("p")).drop("p")
        now, path = numbered(pairs, "left", "right")
        span *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, paths


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_key, gone``: sorted indexes of the lines to delete, for documents with any."""
    spark = docs.sparkSession
    runs, paths = repeated_runs(docs, min_chars)
    place, name = F.struct(*_DOC, "start"), ["lines", "left", "right"]
    intervals = runs.groupBy(*name).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select(*name, "first")
    # written, so that Spark can split the rows of a frequent run in the join
    intervals, intervals_at = written(intervals, "line-intervals")
    later = runs.join(intervals.hint("merge"), name).filter(place > F.col("first"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("lines") - 1)))))
    out, _ = written(later.groupBy(*_DOC).agg(gone.alias("gone")), "lines-gone")
    for path in (*paths, intervals_at):
        drop_table(spark, path)
    return out


def _cleaned(docs: DataFrame, min_chars: int) -> DataFrame:
    """The documents with, as ``_line_text`` and ``_line_gone``, what is left of the text and the lines that go."""
    gone = repeated_lines(docs, min_chars).toDF("_line_d", "_line_k", "_line_gone").hint("merge")
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_line_d"]) & (text_key(docs["text"]) == gone["_line_k"]), "left")
    lines = F.split(text_or_empty(), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_line_gone"))
    text = F.when(F.col("_line_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n"))
    return rows.withColumn("_line_text", text)


def _changed(rows: DataFrame, docs: DataFrame) -> list[Column]:
    """The documents' columns with the new text, and its number of characters where there is a column n_chars."""
    own = {"text": F.col("_line_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("_line_gone").isNull(), F.col("n_chars")).otherwise(F.length("_line_text")).cast(docs.schema["n_chars"].dataType)
    return [own.get(c, F.col(c)).alias(c) for c in docs.columns]


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without repeated runs, with ``n_lines`` and ``n_removed`` in place of columns so named.

    A column n_chars, where there is one, holds the new number of characters.
    """
    rows = _cleaned(docs, min_chars)
    columns = [c for c, name in zip(_changed(rows, docs), docs.columns, strict=True) if name not in ("n_lines", "n_removed")]
    lines = F.size(F.split(text_or_empty(), "\n", -1)).cast("long")
    return rows.select(*columns, lines.alias("n_lines"), F.coalesce(F.size("_line_gone"), F.lit(0)).cast("long").alias("n_removed"))


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, keep_emptied: bool = True) -> DataFrame:
    """The documents, with all columns they had, without repeated runs of lines; on wish without texts that lose all."""
    rows = _cleaned(docs, min_chars)
    if not keep_emptied:
        rows = rows.filter(F.col("_line_gone").isNull() | (F.col("_line_text") != ""))
    return rows.select(*_changed(rows, docs))
