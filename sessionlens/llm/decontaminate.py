"""Test items inside documents: containment search by MinHash sketches, verified exactly.

An item is contained in a document when at least 3/4 of its 5-word shingles are in it, however long the document
is. An item's sketch is its smallest shingle hashes, one more than may be missing: whatever contains the item has
one of them, so the search loses nothing. Items are partitioned by size, and each class has a table of its own sketches:
a document asks each class once, with no more of its hashes than lie below the largest sketch hash of the class
(about a quarter of all for large items), and only classes that fit into it. What a sketch finds is compared shingle by shingle.

Items of fewer than ``least_words`` words (five, a whole shingle) stand in any text; they are not searched, ``short_items`` lists them.

Items are dealt into blocks of bounded size; each block is sent to the tasks and the documents pass it without a
shuffle, a scan for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import SHINGLE, flat, keyed, same_document, shingle_hashes, slices, text_key, unpacked, word_count, word_hashes
from sessionlens.sources.sinks import staged

NUM, DEN = 3, 4
LEAST_WORDS = SHINGLE  # of an item that is searched
BLOCK_WORDS = 1 << 20  # words of the items in a block, which bounds what is broadcast to some 20 MB


class _Items:
    """The items of a block, their shingles, and their sketches by size class."""

    def __init__(self, ids: list, texts: list[str]):
        words = word_hashes(pa.array(texts, pa.string()))
        self.ids = ids
        self.sets = [np.unique(shingle_hashes(w)) for w in words]
        self.needed = [-(-NUM * len(s) // DEN) for s in self.sets]
        self.lengths = sorted({min(len(w), SHINGLE) for w in words if len(w)})
        by_size: dict[int, list[int]] = {}
        for i, own in enumerate(self.sets):
            if len(own):
                by_size.setdefault(len(own).bit_length(), []).append(i)
        self.classes = [(min(self.needed[i] for i in members), *self._sketches(members)) for _, members in sorted(by_size.items())]

    def _sketches(self, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted sketch hashes of a class, and whose they are."""
        parts = [self.sets[i][: len(self.sets[i]) - self.needed[i] + 1] for i in members]
        keys = flat(parts, np.uint64)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.repeat(np.array(members, np.int64), [len(p) for p in parts])[order]

    def inside(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that a text contains."""
        runs = [shingle_hashes(words, n) for n in self.lengths if n <= len(words)]
        if not runs:
            return []
        own, out = np.unique(flat(runs, np.uint64)), []
        for least, keys, items in self.classes:
            if least > len(own):  # so are all larger classes
                break
            asked = own[: np.searchsorted(own, keys[-1], "right")]
            first = np.searchsorted(keys, asked)
            found = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == asked)
            if not len(found):
                continue
            last = np.searchsorted(keys, asked[found], "right")
            maybe = np.unique(np.concatenate([items[a:b] for a, b in zip(first[found], last)]))
            for i in maybe.tolist():
                at = np.minimum(np.searchsorted(own, self.sets[i]), len(own) - 1)
                if (shared := int((own[at] == self.sets[i]).sum())) >= self.needed[i]:
                    out.append((i, shared))
        return out


def _search(block: _Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            ids, keys, out = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), []
            for doc_id, key, words in zip(ids, keys, word_hashes(batch.column("text"))):
                out += [(doc_id, key, block.ids[i], len(block.sets[i]), shared) for i, shared in block.inside(words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "key", "item_id", "item_shingles", "shared"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, key (of the text), item_id, item_shingles, shared, containment of each item in each row of ``docs``.

    Lower-cased words. Items below ``least_words`` are passed over (see ``short_items``); where it is set lower, an item of
    fewer than five words is one shingle and is found where its words stand in a row. Items and documents that are null, empty or white space contain nothing and are in nothing. Repeated items
    count once, repeated documents each; null ids are kept as null. Other columns are not looked at. An empty
    table on either side gives an empty result.
    """
    spark = docs.sparkSession
    only = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    listed = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    listed = staged(listed.withColumn("words", word_count(F.col("text"))).where(F.col("words") >= max(1, least_words)))
    blocks = -(-(listed.agg(F.sum("words")).first()[0] or 0) // BLOCK_WORDS)
    schema = "doc_id long, key long, item_id long, item_shingles long, shared long"
    found = []
    for block in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        rows = own.collect()  # a bounded block
        if rows:
            held = _Items([r.item_id for r in rows], [r.text for r in rows])
            found.append(only.mapInArrow(_search(held), schema))
    out = reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def short_items(items: DataFrame, item_id: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id, text, words of the items that are not searched; null and empty ones have no words."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    return rows.withColumn("words", word_count(F.col("text"))).where(F.col("words") < least_words)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns, whatever their names.

    Rows with null or empty texts contain nothing and stay, repeated rows stay or go together, rows with null ids count like
    others. Items that ``contained_items`` passes over don't remove anything; without items all rows stay.
    """
    rows = keyed(docs, text, doc_id)
    found = staged(contained_items(docs, items, text, doc_id, least_words=least_words).select("doc_id", "key").distinct())
    return unpacked(rows.join(found, same_document(rows, found), "left_anti"))
