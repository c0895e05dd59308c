"""Near copies by SimHash: fingerprints that differ in few bits, found in a hierarchy over their Gray order.

Fingerprints sorted by their place in the reflected Gray code stand next to ones that share long bit patterns. Eight
neighbours make a node that holds the pattern they share and the mask of the shared bits; eight nodes make a node
above them, and so on. Two nodes are compared by the bits that both masks have: if those differ in more than the
allowed number, no member of one is near a member of the other, and both groups go at once. What is left is split
into the nodes below, where the masks are longer and the differences add up, down to the fingerprints.

Two fingerprints that differ in at most three bits agree on one of four quarters. So the order is made four times, with
each quarter in front, and a search stays under the top nodes in whose front quarter it agrees: a fingerprint travels
four times, whatever the size of the corpus, and is never sent to the many nodes that differ from it at the front.

The order is cut into blocks of bounded size. A block is one task's hierarchy; blocks that a front quarter spans
are nodes of a hierarchy of tables, descended in pairs by joins, and only pairs of blocks that may hold near members
meet. Both return links that span the components they found, never all pairs, and groups that are one component
already are not descended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlens.llm.common import components, hot_join, lower_bytes, slices
from sessionlens.sources.sinks import drop_staged, staged

SHINGLE = 3
SEED = 42
BITS = 3  # differences of linked fingerprints
QUARTER = 16
BLOCK = 1 << 14  # fingerprints in a block
SHELF = 32  # blocks, and nodes of blocks, in a node above
_FAN = 8
_PIECE = 1 << 15  # shingles, and pairs of nodes, at a time
_FRONT = np.uint64(64 - QUARTER)


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a UTF-8 text: a bit is set where over half of its shingles' hashes have it; 0 without words."""
    words = lower_bytes(text or b"").split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    whole, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts, stops = (np.r_[0, ends + 1][: len(words) - size + 1]).tolist(), ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _PIECE):
        piece = zip(starts[at : at + _PIECE], stops[at : at + _PIECE])
        hashes = np.array([digest(whole[a:b], SEED) for a, b in piece], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        found = [fingerprint(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def gray_rank(code: Column) -> Column:
    """Place of a code word (a long, read as unsigned) in the reflected Gray code, as a long that sorts the same way."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


class Hierarchy:
    """Patterns and masks of sorted codes: level 0 the codes, each level above one node for eight."""

    def __init__(self, codes: np.ndarray):
        self.levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
        while len(self.levels[-1][0]) > _FAN:
            pattern, mask = (_eights(x) for x in self.levels[-1])
            first = pattern[:, :1]
            shared = np.bitwise_and.reduce(mask & ~(pattern ^ first), axis=1)
            self.levels.append((first[:, 0] & shared, shared))

    def spans(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest label below each node, by level."""
        out = [(labels, labels)]
        for _ in self.levels[1:]:
            out.append((_eights(out[-1][0]).min(axis=1), _eights(out[-1][1]).max(axis=1)))
        return out


def _eights(values: np.ndarray) -> np.ndarray:
    """Rows of eight; the last is filled up with its last value."""
    return np.pad(values, (0, -len(values) % _FAN), mode="edge").reshape(-1, _FAN)


def _near(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of nodes that may hold members that agree in front and differ in few bits; exact for codes."""
    differ = (x[0][i] ^ y[0][j]) & x[1][i] & y[1][j]
    return (differ >> _FRONT == 0) & (np.bitwise_count(differ) <= BITS)


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked members one label, the smallest; a label is the place of a member that has it."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def _descend(x: Hierarchy, y: Hierarchy, labels: np.ndarray, base: int) -> None:
    """Merge the labels of near members of ``x`` (from 0) and ``y`` (from ``base``), from the top nodes down in pairs."""
    same = x is y
    span = lambda: (x.spans(labels[: len(x.levels[0][0])]), y.spans(labels[base : base + len(y.levels[0][0])]))
    spans, level = span(), max(len(x.levels), len(y.levels)) - 1
    i, j = (g.ravel() for g in np.meshgrid(*[np.arange(len(h.levels[min(level, len(h.levels) - 1)][0])) for h in (x, y)], indexing="ij"))
    todo = [(level, i, j)]
    while todo:
        level, i, j = todo.pop()
        if len(i) > _PIECE:
            todo += [(level, i[at : at + _PIECE], j[at : at + _PIECE]) for at in range(0, len(i), _PIECE)]
            continue
        own = [min(level, len(h.levels) - 1) for h in (x, y)]
        (low, high), (low2, high2) = spans[0][own[0]], spans[1][own[1]]
        keep = _near(x.levels[own[0]], y.levels[own[1]], i, j)
        keep &= (low[i] != high[i]) | (low2[j] != high2[j]) | (low[i] != low2[j])
        if same:
            keep &= i <= j if level else i < j
        i, j = i[keep], j[keep]
        if level == 0:
            if len(i):
                _merge(labels, i, base + j)
                spans = span()
            continue
        for k, h in enumerate((x, y)):
            if own[k] == level:  # the smaller hierarchy waits at its top
                kids = ((i, j)[k][:, None] * _FAN + np.arange(_FAN)).ravel()
                i, j = (kids, np.repeat(j, _FAN)) if k == 0 else (np.repeat(i, _FAN), kids)
                real = kids < len(h.levels[level - 1][0])
                i, j = i[real], j[real]
        todo.append((level - 1, i, j))


def _links(codes: np.ndarray, labels: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that is not its component's first, and that first."""
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    back = [_turned(codes[at], (4 - turn) % 4).view(np.int64) for at in (labels[moved], moved)]
    return back[0], back[1]


def _turned(codes: np.ndarray, quarters: int) -> np.ndarray:
    """Codes with their first ``quarters`` quarters moved to the end."""
    left = np.uint64(QUARTER * quarters)
    return codes if not quarters else (codes << left) | (codes >> (np.uint64(64) - left))


def _linked(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Labels of the codes of a block, or of two, sorted by Gray rank each; neighbours are linked first."""
    codes = x if y is None else np.concatenate([x, y])
    labels = np.arange(len(codes))
    close = np.flatnonzero(np.bitwise_count(codes[1:] ^ codes[:-1]) <= BITS)
    _merge(labels, close, close + 1)
    first = Hierarchy(x)
    _descend(first, first if y is None else Hierarchy(y), labels, 0 if y is None else len(x))
    return labels


_FOUND = "a long, b long, turn int, block long, front long, back long, pattern long, mask long, codes binary"


def _block_row(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A block as a row, after the links inside it."""
    turn, codes = batch.column("turn")[0].as_py(), batch.column("code").to_numpy().view(np.uint64)
    a, b = _links(codes, _linked(codes), turn)
    varies = np.bitwise_or.reduce(codes ^ codes[0])
    fronts = (codes[[0, -1]] >> _FRONT).tolist()
    own = [turn, batch.column("id")[0].as_py(), *fronts, (codes[0] & ~varies).view(np.int64).item(), (~varies).view(np.int64).item(), codes.tobytes()]
    columns = [pa.array([*x.tolist(), None], pa.int64()) for x in (a, b)]
    columns += [pa.array([None] * len(a) + [v], t) for v, t in zip(own, [pa.int32(), *[pa.int64()] * 5, pa.binary()])]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FOUND.split(", ")])


def _blocks(size: int):
    """Cuts the runs of a turn in a sorted partition into blocks of ``size`` codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            turns = batch.column("turn").to_numpy()
            cuts = [0, *(np.flatnonzero(turns[1:] != turns[:-1]) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if held and start < stop and held[0].column("turn")[0].as_py() != turns[start]:
                    yield _block_row(pa.concat_batches(held))
                    held = []
                while start < stop:
                    held.append(batch.slice(start, min(size - sum(h.num_rows for h in held), stop - start)))
                    start += held[-1].num_rows
                    if sum(h.num_rows for h in held) == size:
                        yield _block_row(pa.concat_batches(held))
                        held = []
        if held:
            yield _block_row(pa.concat_batches(held))

    return run


def _across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between two blocks."""
    for frame in frames:
        for turn, x, y in zip(frame["turn"], frame["codes"], frame["codes2"]):
            x, y = (np.frombuffer(c, np.uint64) for c in (x, y))
            a, b = _links(np.concatenate([x, y]), _linked(x, y), turn)
            yield pd.DataFrame({"a": a, "b": b})


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """turn, x, y: blocks that share a front quarter and may have near members, by the same descent on tables."""
    spanned = blocks.select("turn", F.explode(F.array_distinct(F.array("front", "back"))).alias("front"), "block", "pattern", "mask")
    order = Window.partitionBy("turn", "front")
    spanned = spanned.withColumn("no", F.row_number().over(order.orderBy("block")) - 1).withColumn("n", F.count("*").over(order)).where("n > 1")
    levels = [staged(spanned.select("turn", "front", "no", "block", "pattern", "mask"))]
    deepest = levels[0].agg(F.max("no")).first()[0]
    if deepest is None:
        return levels[0].select("turn", F.col("block").alias("x"), F.col("block").alias("y"))
    while deepest >= SHELF:
        shared = F.expr("bit_and(mask) & ~(bit_or(pattern) ^ bit_and(pattern))")
        up = levels[-1].groupBy("turn", "front", F.expr(f"no div {SHELF}").cast("int").alias("no")).agg(F.expr("bit_and(pattern)").alias("all"), shared.alias("mask"))
        levels.append(staged(up.select("turn", "front", "no", F.expr("all & mask").alias("pattern"), "mask")))
        deepest //= SHELF

    def side(table: DataFrame, s: str) -> DataFrame:
        return table.select("turn", "front", *[F.col(c).alias(c + s) for c in table.columns[2:]])

    may = F.expr(f"nox <= noy and bit_count((patternx ^ patterny) & maskx & masky) <= {BITS}")
    pairs = side(levels[-1], "x").join(side(levels[-1], "y"), ["turn", "front"]).where(may)
    for table in levels[-2::-1]:
        above = pairs.select("turn", "front", F.col("nox").alias("upx"), F.col("noy").alias("upy"))
        for s in "xy":
            below = side(table, s)
            above = above.join(below.withColumn(f"up{s}", F.expr(f"no{s} div {SHELF}").cast("int")), ["turn", "front", f"up{s}"])
        pairs = staged(above.where(may))
    return staged(pairs.where("nox < noy").select("turn", F.col("blockx").alias("x"), F.col("blocky").alias("y")).distinct())


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """(a, b): links that span the components of the distinct fingerprints in column ``fp``."""
    turned = [F.shiftleft("fp", QUARTER * q).bitwiseOR(F.shiftrightunsigned("fp", 64 - QUARTER * q)) if q else F.col("fp") for q in range(4)]
    turns = F.array(*[F.struct(F.lit(q).alias("turn"), code.alias("code")) for q, code in enumerate(turned)])
    codes = prints.select("fp").distinct().select(F.inline(turns)).withColumn("rank", gray_rank(F.col("code")))
    ordered = codes.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank").select("turn", "code", F.monotonically_increasing_id().alias("id"))
    found = staged(ordered.mapInArrow(_blocks(BLOCK), _FOUND))
    blocks = found.where("block is not null")
    pairs = _block_pairs(blocks)
    x = blocks.select(F.col("block").alias("x"), "codes")
    y = blocks.select(F.col("block").alias("y"), F.col("codes").alias("codes2"))
    between = pairs.join(x, "x").join(y, "y").mapInPandas(_across, "a long, b long")
    return staged(found.where("a is not null").select("a", "b").union(between).distinct())


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    ``component_id`` is the smallest id that links lead to, the own one included. Words are lower-cased (A-Z); texts
    of fewer than three words are one shingle; null, empty and white texts have fingerprint zero, which links
    like any other. Texts count whole, whatever their length. Repeated rows stay repeated and are linked. A null id stays
    null; its component is the smallest id it is linked to, null if there is none. Other columns, whatever their
    names, are not looked at. An empty table gives an empty result.
    """
    only = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(only.mapInArrow(_fingerprints, "doc_id long, fp long"))
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("own"), F.count("*").alias("n")))
    links = linked_fingerprints(classes)
    roots = components(links)
    labels = staged(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", "n", F.coalesce("root", "fp").alias("root")))
    lowest = staged(labels.groupBy("root").agg(F.min("own").alias("component_id"), F.count("*").alias("members")))
    named = hot_join(labels, lowest, "root", "members").select("fp", "n", "component_id")
    named = staged(named)
    out = hot_join(rows, named, "fp", "n")
    drop_staged(classes, links, labels, lowest)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
