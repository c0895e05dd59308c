"""What several of the corpus operators need: words, shingles, document keys, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.sources.sinks import drop_staged, staged

WORD_SPACE = "[ \\t-\\r]+"
SHINGLE = 5
COMPONENT_ROWS = 200_000  # links in a file
HOT = 1000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_bytes(text: bytes) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return text.translate(_LOWER)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; 0 for null."""
    parts = F.filter(F.split(text, WORD_SPACE), lambda w: w != "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """With the id, the key of a document; equal rows share it, and so get equal results. Null is not ''."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; of a shorter text, one for the whole of it."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):  # hashes of words are spread evenly already
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[i : i + len(total)]
    return mixed(total)


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """row (a struct of all columns, whatever their names), doc_id, key: ready to join and to unpack again."""
    return docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on doc_id, which may be null, and key."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["key"] == right["key"])


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with a table that has one row for each ``key`` and says how many rows have it.

    A key of 1/HOT of all rows or more would fill a task. There are HOT of them at most: these rows of the table are
    broadcast, the others meet by a shuffle. Both should be staged, as they are read twice.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(count) * HOT >= total).drop(count))  # HOT rows at most
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) * HOT < total).drop(count).hint("merge"), key)
    return rows.join(hot, key).unionByName(rest)


def unpacked(rows: DataFrame, **changed: Column) -> DataFrame:
    """The columns inside ``row``, some of them replaced or, if they are new, appended."""
    names, own = rows.schema["row"].dataType.names, {c: f"_new{i}" for i, c in enumerate(changed)}
    # In two steps: beside new columns named like old ones, Spark may take one for the other.
    rows = rows.select("row", *[v.alias(own[c]) for c, v in changed.items()])
    kept = [rows[own[c]].alias(c) if c in own else rows["row"].getField(c).alias(c) for c in names]
    return rows.select(*kept, *[rows[own[c]].alias(c) for c in own if c not in names])


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[np.frombuffer(_LOWER, np.uint8)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0xD6E8FEB86659FD93
_PIECE = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its lower-cased (A-Z) words, in order; none for null.

    A word's hash is a polynomial of its bytes modulo 2^64, from differences of running sums over pieces of
    about a megabyte, so the time is a few array operations and the memory doesn't grow with the text.
    """
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[ends[:-1]] = inside[ends[:-1]]
    stops = inside[:-1] & (~inside[1:] | begins[1:])
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    out = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(stops, begins[at] + _PIECE, "right")))
        base, size = begins[at], stops[to - 1] - begins[at]
        power, inverse = _powers_to(max(size + 1, _PIECE + 1))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[base : base + size]] * power[:size], out=sums[1:])
        first, last = begins[at:to] - base, stops[at:to] - base
        out[at:to] = mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
        at = to
    return np.split(out, np.searchsorted(begins, ends[1:-1])) if len(texts) else []


def flat(lists: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(lists).astype(dtype, copy=False) if lists else np.empty(0, dtype)


def list_array(lists: list[np.ndarray], dtype=np.int64) -> pa.Array:
    """Arrays as a list column; uint64 is kept bit by bit as int64."""
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    values = flat(lists, lists[0].dtype if lists else dtype)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): (node, root), root the smallest node of the component.

    Every pass joins each node to its smallest neighbour, follows the joins twice and replaces the links by
    those between what was joined; it at least halves the nodes, so the number of passes is logarithmic.
    Only minima are aggregated, which combine before the shuffle: a node with very many links is no
    bottleneck. Null ends and loops don't count. Every pass is written out, which cuts the lineage, in as many
    files as the number of links asks for.
    """
    links = staged(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parts = 1 + links.count() // COMPONENT_ROWS

    def kept(df: DataFrame) -> DataFrame:
        return staged(df.coalesce(parts))

    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = kept(nodes.withColumn("root", F.col("node")))
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        first = kept(near)
        step = first.alias("x").join(first.alias("y"), F.col("x.p") == F.col("y.a"))
        parent = kept(step.select(F.col("x.a").alias("node"), F.col("y.p").alias("p")))
        left = links.join(parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
        right = left.join(parent.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        onward = kept(right.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        moved = roots.join(parent.select(F.col("node").alias("root"), "p"), "root", "left")
        onward_roots = kept(moved.select("node", F.coalesce("p", "root").alias("root")))
        drop_staged(links, roots, first, parent)
        links, roots = onward, onward_roots
    return roots


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal ``keys`` (whole numbers, not null) in a sorted partition, each as one batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.concat_batches([held, batch]) if held is not None else batch
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)
        held = batch.slice(starts[-1])
    if held is not None:
        yield held


def number_lists(column: pa.ListArray) -> list[np.ndarray]:
    """A list column of whole numbers as arrays of uint64."""
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64), (ends[1:-1] - ends[0]))
