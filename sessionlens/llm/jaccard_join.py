"""Exact Jaccard join of shingle sets with signature trees.

Two documents are linked when their sets of 5-word shingles overlap by at least 3/4 of their union. Equal sets
are one class. Whatever the order of shingles, two linked sets share one of the first floor(n/4) + 1 shingles of
each, so those prefixes deal the classes out to trees: a shingle that several classes have in their prefix hangs
them on one tree, named after the smallest of these classes, so that near copies, which share many shingles,
hang together on few trees. Common shingles come last in the order.

A class whose prefix and the next shingles are mostly its own is linked to nothing and hangs on no tree.

Trees whose members have a first tree in common share most of them and are worked on together.

A tree's members are cut by size into blocks. In a block, a node holds the range of sizes and the OR of the token
bitmaps of what is below it; pairs of nodes go down together as long as the sizes are within 3/4 and the shared
bits allow the overlap that is needed. Pairs of documents that are left are compared exactly, unless links found
already join them: a block yields links that span its components, not all pairs. Blocks of one tree meet in the
same way: their roots are compared first, and blocks that already lie in one component don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sessionlens.llm.common import components, groups, hot_join, keyed, list_array, number_lists, same_document, shingle_hashes, slices, text_key, unpacked, word_hashes
from sessionlens.sources.sinks import drop_staged, staged

NUM, DEN = 3, 4  # the similarity, as a fraction
FAN = 8  # children of a node
COMMON = 1000  # a shingle in more than one of so many documents is common
COMMON_MOST = 1 << 18  # bound of the broadcast list of common shingles; the list only orders
CHUNK = 1 << 22  # shingles counted at a time
FILTER_BITS = 25  # the member filter has 2^25 bits, 4 MB, at any size
BLOCK_ROWS, BLOCK_TOKENS = 1024, 1 << 22  # 32 MB of shingles
ROOT_BITS = 4096

_SETS = "doc_id long, key long, n long, cid long, kind int"
_POSTINGS = "key long, cid long, n long, kind int, shared long"
_TOKENS = "cid long, tokens array<long>"
_LINKS = "a long, b long, tree long, block long, low long, high long, slack long, bits binary"


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(words))


def class_id(tokens: np.ndarray) -> int:
    """A 64-bit digest of the sorted set, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _sets():
    """kind 0: a document's size and class; kind 1: a shingle common in a chunk, its count and smallest class."""

    def common(tokens: list[np.ndarray], cids: list[int]) -> pa.RecordBatch:
        sizes = [len(t) for t in tokens]
        values = np.concatenate(tokens)
        owners = np.repeat(np.array(cids, np.int64), sizes)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        counts = np.diff(np.r_[starts, len(values)])
        lowest = np.minimum.reduceat(owners, starts)
        keep = counts >= max(8, len(sizes) // COMMON)
        shingles = pa.array(values[starts][keep].view(np.int64))
        return rows(pa.nulls(len(shingles), pa.int64()), shingles, counts[keep], lowest[keep], 1)

    def rows(doc_id: pa.Array, key: pa.Array, n, cid, kind: int) -> pa.RecordBatch:
        arrays = [doc_id, key, pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(np.full(len(doc_id), kind, np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n", "cid", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cids, size, seen = [], [], 0, set()
        for batch in slices(batches, 1024):
            n, cid = [], []
            for words in word_hashes(batch.column("text")):
                tokens = shingle_set(words)
                n.append(len(tokens))
                cid.append(class_id(tokens) if len(tokens) else None)
                if len(tokens) and cid[-1] not in seen:
                    seen.add(cid[-1])
                    held.append(tokens)
                    cids.append(cid[-1])
                    size += len(tokens)
                if size >= CHUNK:
                    yield common(held, cids)
                    held, cids, size, seen = [], [], 0, set()
            yield rows(batch.column("doc_id"), batch.column("key"), n, cid, 0)
        if held:
            yield common(held, cids)

    return run


def _postings(common_keys: np.ndarray, common_trees: np.ndarray):
    """What each class hangs on and is counted by.

    kind 0: a shingle of its prefix; kind 1: one that only counts; kind 2: the tree of common shingles of its prefix.
    ``shared`` of kind 2 is the number of its common shingles that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, 512):
            keys, cids, sizes, kinds, counts = [], [], [], [], []
            for words in word_hashes(batch.column("text")):
                tokens = shingle_set(words)
                if not len(tokens) or (cid := class_id(tokens)) in seen:
                    continue
                seen.add(cid)
                n = len(tokens)
                most, counted = prefix_length(n), counted_length(n)
                at = np.minimum(np.searchsorted(common_keys, tokens), max(len(common_keys) - 1, 0))
                late = common_keys[at] == tokens if len(common_keys) else np.zeros(n, bool)
                own = tokens[~late][:counted]
                rest = at[late][: max(0, most - len(own))]
                trees = np.unique(common_trees[rest]) if len(rest) else np.empty(0, np.int64)
                common = counted - len(own)
                if common and not len(trees):
                    trees = np.array([cid])  # a tree of its own: only carries the count
                shared = np.zeros(len(own) + len(trees), np.int64)
                shared[len(own) : len(own) + 1] = common
                kind = np.repeat(np.array([0, 1, 2], np.int32), [min(most, len(own)), max(0, len(own) - most), len(trees)])
                for column, values in ((keys, own.view(np.int64)), (keys, trees), (cids, np.full(len(kind), cid)), (sizes, np.full(len(kind), n)), (kinds, kind), (counts, shared)):
                    column.append(values)
            if cids:
                columns = [pa.array(np.concatenate(c)) for c in (keys, cids, sizes, kinds, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "cid", "n", "kind", "shared"])

    return run


def prefix_length(n: int) -> int:
    """Sets of n shingles that share none of so many with another set are not linked to it."""
    return n - -(-NUM * n // DEN) + 1


def counted_length(n: int) -> int:
    """Of so many first shingles, a linked set has all but prefix_length(n) - 1."""
    return min(n, prefix_length(n) + n // 8)


def _member_tokens(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, 512):
            cids, tokens = [], []
            for words in word_hashes(batch.column("text")):
                own = shingle_set(words)
                if len(own) and (cid := class_id(own)) not in seen:
                    bit = cid & ((1 << FILTER_BITS) - 1)
                    if bits[bit >> 6] >> np.uint64(bit & 63) & np.uint64(1):
                        seen.add(cid)
                        cids.append(cid)
                        tokens.append(own)
            if cids:
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), list_array(tokens)], ["cid", "tokens"])

    return run


class _Tree:
    """Levels of nodes over members in order of size: leaves first, one root last."""

    def __init__(self, tokens: list[np.ndarray], width: int):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        bits = np.zeros((len(tokens), width), bool)
        for row, own in zip(bits, tokens):
            row[own & np.uint64(width - 1)] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        slack = self.sizes - np.bitwise_count(packed).sum(1, dtype=np.int64)
        self.levels = [(self.sizes, self.sizes, slack, packed)]
        while len(self.levels[-1][0]) > 1:
            low, high, slack, packed = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut), np.bitwise_or.reduceat(packed, cut)))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def possible(x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of nodes (x[i], y[j]) may have linked sets below them.

    Two sets share at most their common bits and what either has beyond its bits (slack), and need 3/7 of the
    sum of their sizes.
    """
    (low, high, slack, bits), (low2, high2, slack2, bits2) = x, y
    ok = (DEN * high[i] >= NUM * low2[j]) & (DEN * high2[j] >= NUM * low[i])
    at = np.flatnonzero(ok)
    step = max(1024, (1 << 25) // bits[0].nbytes)
    for part in np.array_split(at, len(at) // step + 1):
        a, b = i[part], j[part]
        shared = np.bitwise_count(bits[a] & bits2[b]).sum(1, dtype=np.int64) + np.minimum(slack[a], slack2[b])
        ok[part] = (NUM + DEN) * shared >= NUM * (low[a] + low2[b])
    return ok


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exactly: shared / union >= 3/4, for sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return (NUM + DEN) * shared >= NUM * (len(a) + len(b))


class _Joined:
    """Union-find over the members of a unit of work, with the links that made it."""

    def __init__(self, labels: list):
        first = {}
        self.up = np.array([first.setdefault(x, i) for i, x in enumerate(labels)])
        self.links = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        while (self.up != (onward := self.up[self.up])).any():
            self.up = onward
        return self.up

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        self.links.append((i, j))


def _descend(x: _Tree, y: _Tree, tokens: list[np.ndarray], in_x: list[int], in_y: list[int], joined: _Joined) -> None:
    """Go down both trees together and join what is linked; ``in_x`` and ``in_y`` are the places of their members."""
    same = x is y
    top = max(len(x.levels), len(y.levels)) - 1
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(x.level(top)[0])), np.arange(len(y.level(top)[0]))))
    for k in range(top, -1, -1):
        keep = possible(x.level(k), y.level(k), i, j)
        if same:
            keep &= i < j if k == 0 else i <= j
        i, j = i[keep], j[keep]
        if k:
            for tree, is_x in ((x, True), (y, False)):
                if k < len(tree.levels):
                    below = len(tree.levels[k - 1][0])
                    own = (i if is_x else j)[:, None] * FAN + np.arange(FAN)
                    other = np.repeat(j if is_x else i, FAN).reshape(own.shape)
                    inside = own < below
                    i, j = (own[inside], other[inside]) if is_x else (other[inside], own[inside])
    i, j = np.asarray(in_x)[i], np.asarray(in_y)[j]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    while len(i):
        roots = joined.roots()
        apart = roots[i] != roots[j]
        i, j = i[apart], j[apart]
        for a, b in zip(i[:2048].tolist(), j[:2048].tolist()):
            if joined.root(a) != joined.root(b) and linked(tokens[a], tokens[b]):
                joined.join(a, b)
        i, j = i[2048:], j[2048:]


def _width(tokens: list[np.ndarray]) -> int:
    return max(256, 1 << int(2 * max(map(len, tokens)) - 1).bit_length())


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(x, np.int64).view(np.uint64) for x in column]


def _frame(links: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each unit the links that span the components of its trees, and its root if its tree has other blocks.

    A unit is a block of one tree, or all of the trees of a family.
    """
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        types = [*[pa.int64()] * 7, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in _LINKS.split(", ")])

    for unit in groups(batches, ["unit", "block"]):
        cids, first = np.unique(unit.column("cid").to_numpy(), return_index=True)
        lists, names = number_lists(unit.column("tokens")), unit.column("trees").to_pylist()
        order = np.lexsort((cids, [len(lists[i]) for i in first]))
        cids, tokens = cids[order].tolist(), [lists[i] for i in first[order]]
        joined, members = _Joined(cids), {}
        for at, i in enumerate(first[order].tolist()):
            for tree in names[i]:
                members.setdefault(tree, []).append(at)
        for tree, own in sorted(members.items()):
            hub = next((i for i in own if cids[i] == tree), own[0])
            for i in own:  # near copies are mostly linked to the class that the tree is named after
                if joined.root(i) != joined.root(hub) and linked(tokens[i], tokens[hub]):
                    joined.join(hub, i)
            roots = joined.roots()[own]
            if len(own) > 2 and (roots != roots[0]).any():
                nodes = _Tree([tokens[i] for i in own], _width([tokens[i] for i in own]))
                _descend(nodes, nodes, tokens, own, own, joined)
        out += [(cids[i], cids[j], *[None] * 6) for i, j in joined.links]
        if unit.column("split")[0].as_py():
            low, high, slack, bits = (x[0] for x in _Tree(tokens, ROOT_BITS).levels[-1])
            out.append((None, None, unit.column("unit")[0].as_py(), unit.column("block")[0].as_py(), int(low), int(high), int(slack), bits.tobytes()))
        if len(out) > 1024:
            yield flush()
            out = []
    if out:
        yield flush()


def _across(pair: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks whose components are not joined yet."""
    sides = [side.drop_duplicates("cid").sort_values(["n", "cid"]) for _, side in pair.groupby("side")]
    if len(sides) < 2:
        return _frame([])
    both = pd.concat(sides)
    cids, tokens = both["cid"].tolist(), _arrays(both["tokens"])
    base, width, joined = len(sides[0]), _width(tokens), _Joined(both["root"].tolist())
    _descend(_Tree(tokens[:base], width), _Tree(tokens[base:], width), tokens, list(range(base)), list(range(base, len(tokens))), joined)
    return _frame([(cids[i], cids[j]) for i, j in joined.links])


@F.pandas_udf(T.BooleanType())
def _roots_meet(low: pd.Series, high: pd.Series, slack: pd.Series, bits: pd.Series, low2: pd.Series, high2: pd.Series, slack2: pd.Series, bits2: pd.Series) -> pd.Series:
    def node(*columns):
        return *(c.to_numpy(np.int64) for c in columns[:3]), np.frombuffer(b"".join(columns[3]), np.uint64).reshape(-1, ROOT_BITS // 64)

    at = np.arange(len(low))
    return pd.Series(possible(node(low, high, slack, bits), node(low2, high2, slack2, bits2), at, at))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key, n_shingles, class_id, group_id, component_id of every row of ``docs``.

    ``class_id`` is shared by equal sets, ``group_id`` by linked ones; both are null for empty ones. ``component_id`` is the smallest id that links
    lead to. Null and empty texts, and texts of white space, have no shingles and no links: their component is
    the row's own id. Texts of fewer than five words are one shingle. Repeated rows stay repeated and are
    copies of each other. A null id stays null; its component is the smallest id among the rows it is linked
    to, null if none of them has one. Other columns are not looked at. An empty table gives an empty result.
    """
    only = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    sets = staged(only.mapInArrow(_sets(), _SETS))
    rows, found = sets.where("kind = 0"), sets.where("kind = 1")

    # Common shingles: one that is in 1/COMMON of all documents is so in some chunk.
    least = max(16, rows.count() // COMMON)
    counted = found.groupBy("key").agg(F.sum("n").alias("n"), F.min("cid").alias("tree")).where(F.col("n") >= least)
    listed = counted.orderBy(F.desc("n"), "key").limit(COMMON_MOST).select("key", "tree").toPandas()
    listed = listed.assign(key=listed["key"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
    keys, trees = listed["key"].to_numpy(np.uint64), listed["tree"].to_numpy(np.int64)

    # One shuffle by shingle. Trees of common shingles are known already; their rows are spread by class.
    texts = only.select("text")
    postings = texts.mapInArrow(_postings(keys, trees), _POSTINGS)
    spread = postings.withColumn("deal", F.when(F.col("kind") == 2, F.xxhash64("cid", "key")).otherwise(F.col("key")))
    by = "over (partition by deal)"
    spread = spread.selectExpr("key", "cid", "n", "kind", "shared", f"min(cid) {by} as low", f"max(cid) {by} as high")
    hung = spread.where("kind = 2 or low < high").select("cid", "n", F.when(F.col("kind") == 0, F.col("low")).when(F.col("kind") == 2, F.col("key")).alias("tree"), F.when(F.col("kind") == 2, F.col("shared")).otherwise(1).alias("shared"))
    # What is linked shares most of its counted shingles with others. Repeated classes repeat their rows.
    members = hung.groupBy("cid", "n").agg(F.collect_set("tree").alias("trees"), F.sum("shared").alias("shared"))
    enough = F.expr("shared >= least(n, n - ceil(n * 0.75) + 1 + n div 8) - (n - ceil(n * 0.75))")
    members = staged(members.where(enough).select("cid", "n", F.array_min("trees").alias("lowest"), F.explode("trees").alias("tree")))

    # Members of a tree in blocks, by size and then at random; in each block the class that names the tree.
    # Linked sets are at most 3 classes of size apart; who has no such neighbour on a tree is linked to nothing there.
    sized = members.withColumn("size", F.floor(F.log("n") * 10).cast("long"))
    around = Window.partitionBy("tree").orderBy("size").rangeBetween(-3, 3)
    counts = sized.groupBy("tree", "size").agg(F.count("*").alias("rows"), F.sum("n").alias("volume"), F.min("lowest").alias("l0"), F.max("lowest").alias("l1"))
    counts = counts.withColumn("near", F.sum("rows").over(around)).where("near > 1").drop("near")
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("volume") / BLOCK_TOKENS))
    whole = counts.groupBy("tree").agg(F.sum("rows").alias("all_rows"), F.sum("volume").alias("all_volume"), F.min("l0").alias("l0"), F.max("l1").alias("l1"))
    whole = whole.where("all_rows > 1 and (l0 <> l1 or l0 = tree)")  # else all its members hang on one other tree too
    small = (F.col("all_rows") <= BLOCK_ROWS) & (F.col("all_volume") <= BLOCK_TOKENS)
    plan = counts.drop("l0", "l1").join(whole, "tree").select("tree", "size", F.when(small, 0).otherwise(parts).cast("long").alias("parts"), F.when(small, 0).otherwise(F.col("size") + 1).alias("band"), F.col("l0").alias("family"))
    block = F.when(F.col("parts") == 0, F.lit(0)).otherwise(F.col("band") * 1_000_000 + F.pmod(F.xxhash64("cid"), F.col("parts")))
    placed = sized.join(plan, ["tree", "size"]).select("tree", "family", block.cast("long").alias("block"), "cid", "n", (F.col("parts") > 0).alias("split"))
    placed = staged(placed)
    hubs = placed.where("split").groupBy("tree", "block").count().select("tree", "block", F.col("tree").alias("cid"), F.lit(True))

    # Trees of one family share most members, whose shingles travel once for all of them if they fit together.
    single = placed.where("not split")
    family = single.groupBy("family", "cid").agg(F.first("n").alias("n"), F.collect_set("tree").alias("trees"))
    fits = family.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("volume"))
    fits = staged(fits.where((F.col("rows") <= BLOCK_ROWS) & (F.col("volume") <= BLOCK_TOKENS)).select("family"))
    together = family.join(fits, "family").select(F.col("family").alias("unit"), F.lit(-1).cast("long").alias("block"), "cid", "trees", F.lit(False).alias("split"))
    apart = single.join(fits, "family", "left_anti").select("tree", "block", "cid", "split").union(placed.where("split").select("tree", "block", "cid", "split")).union(hubs)
    apart = apart.select(F.col("tree").alias("unit"), "block", "cid", F.array("tree").alias("trees"), "split")
    units = together.union(apart).join(_tokens_of(texts, members), "cid")
    first = staged(units.repartition("unit", "block").sortWithinPartitions("unit", "block").mapInArrow(_within, _LINKS))

    links = first.where("a is not null").select("a", "b")
    roots = components(links)
    wide = placed.where("split").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    if not wide.isEmpty():
        links = links.union(_between_blocks(staged(wide), first, texts))
        drop_staged(roots)
        roots = components(links)

    full = rows.where("cid is not null")
    ids = full.groupBy("cid").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows"))
    labels = staged(ids.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    lowest = staged(labels.groupBy("root").agg(F.min("own").alias("lowest"), F.count("*").alias("members")))
    labels = staged(hot_join(labels, lowest, "root", "members").select("cid", "root", "lowest", "rows"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("lowest"))
    joined = hot_join(full, labels, "cid", "rows").unionByName(rows.where("cid is null"), allowMissingColumns=True)
    return joined.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), F.col("root").alias("group_id"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with the smallest id (null last) of each component, with all their columns.

    Documents without shingles are linked to nothing and all stay; of other repeated rows one stays.
    """
    found = staged(jaccard_components(docs, text, doc_id))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    heads = found.where("n_shingles > 0").groupBy("group_id").agg(F.min(place).alias("head")).select("head.doc_id", "head.key")
    times = found.groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    heads = staged(heads.join(times, same_document(heads, times)).select(heads["doc_id"], heads["key"], "times"))
    heads = heads.union(found.where("n_shingles = 0").select("doc_id", "key", F.lit(1)).distinct())
    rows = keyed(docs, text, doc_id)
    kept = rows.join(heads.hint("merge"), same_document(rows, heads)).select("row", rows["doc_id"], rows["key"], "times")
    if heads.where("times > 1").isEmpty():
        return unpacked(kept)
    return unpacked(kept.where("times = 1").union(kept.where("times > 1").dropDuplicates(["doc_id", "key"])))


def _tokens_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, tokens of at least the classes in ``wanted``.

    The texts pass a filter of 2^FILTER_BITS bits, which lets some others through where there are very many.
    """
    word = F.expr(f"(cid & {(1 << FILTER_BITS) - 1}) >> 6")
    bit = F.expr("shiftleft(1L, cast(cid & 63 as int))")
    words = wanted.select("cid").distinct().groupBy(word.alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return texts.mapInArrow(_member_tokens(bits), _TOKENS).groupBy("cid").agg(F.first("tokens").alias("tokens"))


def _between_blocks(wide: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between blocks of trees that have several, where the blocks aren't in one component already."""
    nodes = first.where("tree is not null").select("tree", "block", "low", "high", "slack", "bits")
    held = wide.groupBy("tree", "block").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    nodes = nodes.join(held, ["tree", "block"])
    x, y = (nodes.select("tree", *[F.col(c).alias(f"{c}{k}") for c in nodes.columns if c != "tree"]) for k in "xy")
    near = (F.col("blockx") < F.col("blocky")) & (F.col("highx") * DEN >= F.col("lowy") * NUM) & (F.col("highy") * DEN >= F.col("lowx") * NUM)
    apart = (F.col("r0x") != F.col("r1x")) | (F.col("r0y") != F.col("r1y")) | (F.col("r0x") != F.col("r0y"))
    pairs = x.join(y, "tree").where(near & apart)
    pairs = pairs.where(_roots_meet(*[F.col(f"{c}{k}") for k in "xy" for c in ("low", "high", "slack", "bits")]))
    pairs = staged(pairs.select("tree", F.col("blockx").alias("bx"), F.col("blocky").alias("by")))
    if pairs.isEmpty():
        return first.where("false").select("a", "b")
    sides = pairs.select("tree", "bx", "by", F.col("bx").alias("block"), F.lit(0).alias("side")).union(pairs.select("tree", "bx", "by", F.col("by").alias("block"), F.lit(1).alias("side")))
    rows = staged(sides.join(wide.select("tree", "block", "cid", "n", "root"), ["tree", "block"]))
    rows = rows.join(_tokens_of(texts, rows), "cid")
    return staged(rows.groupBy("tree", "bx", "by").applyInPandas(_across, "a long, b long"))
