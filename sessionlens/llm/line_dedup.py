"""Repeated runs of lines, by a suffix array over line numbers; later copies are deleted.

Only DataFrame functions are used. The text of each document is a sequence of line numbers (equal lines, equal
number; blank lines don't count). Prefix doubling ranks the runs of 1, 2, 4, ... lines that start at each line:
the rank of a run of 2^(k+1) lines is the place of the pair of its halves' ranks among all such pairs, sorted
over the whole corpus. Runs that occur once get no rank and drop out, so what is left is the part of the suffix
array with neighbours: suffixes of one rank are an interval whose longest common prefix has 2^k lines or more.

A run counts when it has ``min_words`` words. So for each line two windows matter: the shortest run with enough
words that starts there, and the one that ends there. Their depth depends only on the lines in them, hence all
copies of a run have the same windows, and windows with the same depth and the same ranks of their first and
last 2^k lines (which overlap) are one interval of suffixes at that depth. All windows of an interval but the
first are later copies. A maximal repeated run is the union of the windows inside it, so deleting the lines of
later windows deletes exactly the later copies of maximal runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlens.llm.common import keyed, same_document, text_key, unpacked, word_count
from sessionlens.operators.ranking import salted_join
from sessionlens.sources.sinks import drop_staged, staged

MIN_WORDS = 50
FILE_ROWS = 500_000  # of the tables in between
BLANK = "[ \\t-\\r]+"
DOC = ["doc_id", "key"]


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, "^[ \\t-\\r]+|[ \\t-\\r]+$", "")


def _order(*more: str) -> Column:
    """Place in the corpus: by id (null last), then text, then line."""
    return F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"), *[F.col(c) for c in more])


def line_sequences(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, key, pos (in the text), seq (among the lines that aren't blank), words, h1, h2 of each line."""
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("pos"), _trimmed(line).alias("line")))
    full = F.filter(numbered, lambda x: x["line"] != "")
    rows = docs.where(F.col(text) != "").select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.posexplode(full).alias("seq", "x"))
    line = F.col("x.line")
    return rows.select(*DOC, F.col("x.pos").alias("pos"), "seq", word_count(line).alias("words"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _ranks(rows: DataFrame, by: list[str], parts: int) -> DataFrame:
    """doc_id, key, seq, rank for rows whose ``by`` occurs again; ranks order ``by`` over all rows.

    Only the distinct values are sorted, in ranges; the increasing row id of a sorted table is the rank.
    """
    again = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    ranked = staged(again.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))
    return staged(salted_join(rows, ranked, by, "n", F.struct("key", "seq")).select(*DOC, "seq", "rank").coalesce(parts))


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, start, stop, lines: what later copies of runs of at least ``min_words`` words cover.

    ``start`` and ``stop`` are lines of the text, from 0 and inclusive; ``lines`` counts those that aren't blank.
    Copies in one document count, also if they overlap. The first copy is the one with the smallest id (null
    last), then text hash, then line.
    """
    every = staged(line_sequences(docs, text, doc_id).distinct())  # repeated rows are one document
    often = staged(every.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    lines = salted_join(every, often, ["h1", "h2"], "n", F.struct("key", "seq"))
    # Stretches of lines that all occur again; those with too few words hold no run.
    stretch = F.col("seq") - F.row_number().over(Window.partitionBy(*DOC).orderBy("seq"))
    lines = lines.withColumn("part", stretch)
    part = Window.partitionBy(*DOC, "part")
    lines = lines.withColumn("all", F.sum("words").over(part)).where(F.col("all") >= min_words)
    lines = lines.withColumn("end", F.sum("words").over(part.orderBy("seq"))).withColumn("begin", F.col("end") - F.col("words"))
    ahead, behind = part.orderBy("begin").rangeBetween(0, min_words - 1), part.orderBy("end").rangeBetween(1 - min_words, 0)
    lines = lines.withColumn("ahead", F.when(F.max("end").over(ahead) >= F.col("begin") + min_words, F.count("*").over(ahead)))
    lines = lines.withColumn("behind", F.when(F.min("begin").over(behind) <= F.col("end") - min_words, F.count("*").over(behind)))
    lines = staged(lines.select(*DOC, "pos", "seq", "part", "ahead", "behind", "h1", "h2"))
    drop_staged(every, often)

    rows, deepest = lines.agg(F.count("*"), F.max(F.greatest("ahead", "behind"))).first()
    parts, deepest = 1 + rows // FILE_ROWS, deepest or 0
    levels = [_ranks(lines.select(*DOC, "seq", "h1", "h2"), ["h1", "h2"], parts)]
    while 2 ** len(levels) <= deepest:  # at most log2(min_words) times: a line has a word at least
        step = 2 ** (len(levels) - 1)
        last = levels[-1].withColumnRenamed("rank", "r1")
        second = last.select(*DOC, (F.col("seq") - step).alias("seq"), F.col("r1").alias("r2"))
        pairs = _same(last, second, ["seq"]).select(*DOC, "seq", "r1", "r2")
        levels.append(_ranks(pairs, ["r1", "r2"], parts))

    starts = lines.where("ahead is not null").select(*DOC, "seq", F.col("ahead").alias("depth"))
    ends = lines.where("behind is not null").select(*DOC, (F.col("seq") - F.col("behind") + 1).alias("seq"), F.col("behind").alias("depth"))
    windows = starts.union(ends).distinct().withColumn("level", F.floor(F.log2("depth")).cast("int"))
    windows = windows.withColumn("tail", F.col("seq") + F.col("depth") - F.expr("shiftleft(1, level)"))
    ranks = None
    for level, table in enumerate(levels):
        own = table.withColumn("level", F.lit(level))
        ranks = own if ranks is None else ranks.union(own)
    named = _same(windows, ranks.withColumnRenamed("rank", "first"), ["seq", "level"])
    named = _same(named, ranks.select(*DOC, "level", F.col("seq").alias("tail"), F.col("rank").alias("last")), ["tail", "level"])
    named = staged(named.select(*DOC, "seq", "depth", "first", "last").coalesce(parts))
    interval = ["depth", "first", "last"]
    heads = staged(named.groupBy(*interval).agg(F.min(_order("seq")).alias("head"), F.count("*").alias("n")).where("n > 1"))
    later = salted_join(named, heads, interval, "n", F.struct("key", "seq")).where(_order("seq") != F.col("head"))
    cut = later.select(*DOC, F.explode(F.expr("sequence(seq, seq + cast(depth as int) - 1)")).alias("seq")).distinct()
    cut = _same(cut, lines.select(*DOC, "seq", "pos"), ["seq"])
    cut = cut.withColumn("run", F.col("seq") - F.row_number().over(Window.partitionBy(*DOC).orderBy("seq")))
    out = staged(cut.groupBy(*DOC, "run").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count("*").alias("lines")).drop("run").coalesce(parts))
    drop_staged(lines, named, heads, *levels)
    return out


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on the document, whose id may be null, and on ``on``."""
    right = right.select(*[F.col(c).alias(f"_{c}" if c in (*DOC, *on) else c) for c in right.columns])
    same = left["doc_id"].eqNullSafe(right["_doc_id"]) & (left["key"] == right["_key"])
    for c in on:
        same &= left[c] == right[f"_{c}"]
    return left.join(right, same).drop(*[c for c in right.columns if c.startswith("_")])


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut out of ``text``; with ``report`` also lines_cut and words_cut.

    Lines are compared without white space at their ends. Blank lines are passed over; those inside a run go with
    it, the others are kept. Null and empty texts stay as they are. Repeated rows are one document and get the
    same result. All columns but ``text`` are kept whatever their names; the columns of the report replace columns
    of the same names. An empty table gives an empty result.
    """
    runs = repeated_lines(docs, text, doc_id, min_words).groupBy(*DOC).agg(F.collect_list(F.struct("start", "stop")).alias("cut"), F.sum("lines").alias("lines"))
    rows, runs = keyed(docs, text, doc_id), staged(runs)
    # Many documents have runs, so the table is no broadcast; one plan at all sizes keeps costs in proportion.
    rows = rows.join(runs.hint("merge"), same_document(rows, runs), "left").select("row", "cut", "lines")
    body, none = F.col("row").getField(text), F.col("cut").isNull()
    lines = F.split(body, "\n")

    def gone(i: Column) -> Column:
        return F.exists("cut", lambda run: i.between(run["start"], run["stop"]))

    kept = F.array_join(F.filter(lines, lambda x, i: ~gone(i)), "\n")
    changed = {text: F.when(none, body).otherwise(kept)}
    if report:
        words = word_count(F.array_join(F.filter(lines, lambda x, i: gone(i)), " "))
        changed["lines_cut"] = F.coalesce("lines", F.lit(0)).cast("long")
        changed["words_cut"] = F.when(none, F.lit(0)).otherwise(words).cast("long")
    return unpacked(rows, **changed)
