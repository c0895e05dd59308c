"""Mixing sources to target weights, by pivotal dependent rounding.

Each source gets a number of words in proportion to its weight, but no more than ``most`` times what it has. A
document of a source that is to give r times its words is taken floor(r) times, and once more with probability p =
r - floor(r). The extra copies are drawn by pivotal steps, the longest document first: a document is paired with
the pool of the shorter ones, and words move at random from one side to the other until the document is taken or
left out for certain. That keeps every document's expectation and the number of words drawn, and what is open at
the end is a short document, as a rule, and is rounded, so a source ends within half a document of its target.

The draws run as a reduction tree. Documents are dealt at random into chunks of a source; a chunk ends with one
open document, which goes on to the next level with those of other chunks, until a source has one left, which is
rounded. A source with a third of all documents has more chunks, not larger ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import keyed, mixed, same_document, text_key, unpacked, word_count
from sessionlens.operators.ranking import global_index
from sessionlens.sources.sinks import staged

WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK = 2048
_SURE = 1e-12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n, target of a table (source, size, n) with a row for each source.

    Sources in order of code points, null last, weigh ``weights`` in turn. The words of all sources are shared by
    weight; what is above ``most`` times a source's size goes to the others, until none is above.
    """
    listed = staged(global_index(sizes, F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("index") % len(weights) + 1).cast("int")).cast("double")
    cap = F.col("size") * F.lit(most)
    total = listed.agg(F.sum("size")).first()[0] or 0
    share, above = 0.0, -1
    while True:  # the share of a weight grows with each pass, so a source that is above stays so
        over = weight * F.lit(share) > cap
        free = F.when(~over, weight)
        got = listed.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(free)).first()
        if got[0] == above or not got[2]:
            break
        above, share = got[0], (total - (got[1] or 0)) / got[2]
    target = F.least(weight * F.lit(share), cap.cast("double"))
    return listed.select("source", F.col("size").alias("source_size"), "n", target.alias("target"))


def pooled(mass: np.ndarray, chance: float, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal steps for documents of one chance, ``mass`` falling: each against the pool of all after it.

    Chances after all but one are 0 or 1, and the place of the one that may be open (-1: none). The pool keeps one
    chance, so every expectation stays, as does the sum of mass * chance.
    """
    out, held, pool = np.zeros(len(mass)), -1, chance
    room = float(mass.sum())
    for i, (a, u) in enumerate(zip(mass.tolist(), draws.tolist())):
        x, room = pool, room - a
        if _SURE < x < 1 - _SURE and room > 0:
            up, down = min(a * (1 - x), room * x), min(a * x, room * (1 - x))
            moved = up if u * (up + down) < down else -down
            x, pool = x + moved / a, pool - moved / room
        sure = not _SURE < x < 1 - _SURE
        out[i] = round(x) if sure else x
        held = held if sure else i  # what the pool cannot settle leaves the pool settled
    return out, held


def paired(mass: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """The same for documents of different chances: each step settles one of two open documents."""
    p, held = [float(round(x)) if not _SURE < x < 1 - _SURE else x for x in chance.tolist()], -1
    for i, (b, u) in enumerate(zip(mass.tolist(), draws.tolist())):
        if p[i] in (0.0, 1.0):
            continue
        if held >= 0:
            a, x, y = float(mass[held]), p[held], p[i]
            up, down = min(a * (1 - x), b * y), min(a * x, b * (1 - y))
            moved = up if u * (up + down) < down else -down
            for k, z in ((held, x + moved / a), (i, y - moved / b)):
                p[k] = z if _SURE < z < 1 - _SURE else float(round(z))
        held = next((k for k in (i, held) if k >= 0 and 0 < p[k] < 1), -1)
    return np.array(p), held


def _round(level: int, seed: int):
    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(["mass", "unit"], ascending=[False, True], ignore_index=True)
        units = chunk["unit"].to_numpy(np.int64).view(np.uint64)
        draws = mixed(mixed(units + np.uint64(seed)) + np.uint64(level)).astype(np.float64) / 2.0**64
        mass, chance = chunk["mass"].to_numpy(float), chunk["chance"].to_numpy(float)
        chance, held = paired(mass, chance, draws) if level else pooled(mass, chance[0], draws)
        open_ = np.zeros(len(chunk), bool)
        if held >= 0:
            open_[held] = True
        return chunk.assign(chance=chance, open=open_)

    return run


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """How often each document is taken: doc_id, key, source, rows, size, source_size, target, copies, taken.

    One row for each id, text and source; ``rows`` says how many rows of ``docs`` that is, and all of them are
    taken ``copies`` times, ``taken`` words each. Documents without words, null and empty texts included, are never
    taken. Null is a source like any other, the last. Sources without words have the target 0. Draws depend on
    ids, texts, sources and ``seed`` only, so reruns agree. An empty table gives an empty result.
    """
    only = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    units = staged(only.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.count("*").alias("n"))
    targets = source_targets(sizes, weights, most)
    ratio = F.col("target") / F.nullif("source_size", F.lit(0))
    rows = units.withColumnRenamed("source", "_source").join(targets, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    rows = rows.withColumn("whole", F.least(F.floor(ratio), F.lit(most)).cast("long"))
    rows = rows.withColumn("mass", (F.col("size") * F.col("rows")).cast("double")).withColumn("unit", F.xxhash64("doc_id", "key", "source"))
    rows = rows.withColumn("of", F.xxhash64("source")).withColumn("chunk", F.pmod(F.xxhash64("unit", F.lit(seed)), F.ceil(F.col("n") / CHUNK)))
    rows = staged(rows.withColumn("chance", ratio - F.col("whole")))

    drawn = rows.where("mass > 0").select("unit", "of", "chunk", "mass", "chance")
    schema = "unit long, of long, chunk long, mass double, chance double, open boolean"
    levels, level = [], 0
    deepest = math.ceil(math.log(max(2, (targets.agg(F.max("n")).first()[0] or 0)), CHUNK))
    for level in range(deepest + 1):
        done = staged(drawn.groupBy("of", "chunk").applyInPandas(_round(level, seed), schema))
        levels.append(done)
        drawn = done.where("open").select("unit", "of", F.floor(F.col("chunk") / CHUNK).alias("chunk"), "mass", "chance")
    last = levels.pop()  # one chunk of each source: what is open there goes to the nearer side
    sure = last.select("unit", F.round("chance").alias("extra"))
    for done in reversed(levels):
        sure = sure.union(done.where("not open").select("unit", F.col("chance").alias("extra")))
    copies = F.when(F.col("mass") > 0, F.col("whole") + F.col("extra").cast("long")).otherwise(0).cast("long")
    out = rows.join(sure, "unit", "left").withColumn("copies", copies)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return out.select("doc_id", "key", "source", "rows", "size", "source_size", "target", "copies", taken)


def take_mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with copies, taken, size, source_size and target.

    These replace columns of the same names; all others are kept, whatever their names.
    """
    taken = staged(mix(docs, text, doc_id, source, weights, most, seed).where("copies > 0").drop("rows"))
    rows = keyed(docs, text, doc_id)
    same = same_document(rows, taken) & rows["row"][source].eqNullSafe(taken["source"])
    names = ("copies", "taken", "size", "source_size", "target")
    rows = rows.join(taken.hint("merge"), same).select("row", *names)
    return unpacked(rows, **{c: F.col(c) for c in names})
