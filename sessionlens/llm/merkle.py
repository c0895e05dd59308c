"""A Merkle manifest of a table, with a proof for every row, by pointer jumping.

Rows are leaves. Inside each group (``lang``) the leaves stand in order of their id; every eight neighbours, the last
run fewer, become one node, until one is left, the group's subroot. The subroots, in order of their groups, become
the root in the same way. A leaf's proof holds, level by level, the digests left and right of its own path.

The nodes above the leaves hold the segment of siblings towards their parent. A self-join gives each node the segment
of the ancestor it points to and that ancestor's own pointer, which doubles the distance; after log2(height) joins
every node points to the root of its tree. A run of eight leaves is one row, so the leaves join once, with the finished
segment of their run's node, and seven eighths of all nodes never carry a growing segment through a shuffle.

Near the root a few ancestors serve all nodes. So an ancestor's row is repeated for each 512 nodes that
ask for it, and the join key holds the number of that lane: no key has more than 512 rows on a side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionlens.operators.ranking import global_index
from sessionlens.sources.sinks import drop_staged, staged

FANOUT_BITS = 3  # eight nodes make one
DIGEST = 32
LANE_BITS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left: binary, right: binary>"


def sha256(hex_text: Column) -> Column:
    return F.unhex(F.sha2(hex_text, 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after another, each its length in bytes, ':' and its value; '-' for null."""
    texts = [f.cast("string") for f in fields]
    return sha256(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its proof."""
    return F.aggregate(steps, leaf, lambda d, s: sha256(F.concat(hex_text(s["left"]), hex_text(d), hex_text(s["right"]))))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return sha256(F.array_join(F.transform(steps, lambda s: F.concat(hex_text(s["left"]), hex_text(s["right"]))), ""))


def _joined(kids: Column) -> Column:
    """The digests of a run's nodes in one binary."""
    return F.aggregate(kids, F.lit(b""), lambda all_, k: F.concat(all_, k["digest"]))


def _step(joined: Column, pos: Column) -> Column:
    size = F.lit(DIGEST)
    return F.struct(F.substring(joined, F.lit(1), pos * size).alias("left"), F.substring(joined, (pos + 1) * size + 1, F.lit(DIGEST << FANOUT_BITS)).alias("right"))


def _halved(n: str) -> Column:
    """How many nodes ``n`` nodes become."""
    return F.shiftright(F.col(n) + ((1 << FANOUT_BITS) - 1), FANOUT_BITS)


def _height() -> Column:
    """Levels above a tree's ``n`` lowest nodes: octal digits of n - 1."""
    return F.when(F.col("n") <= 1, 0).otherwise(F.length(F.conv((F.col("n") - 1).cast("string"), 10, 1 << FANOUT_BITS)))


def _paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of trees given by their lowest nodes (tree, idx, digest, n): the roots (tree, digest, n) and (tree, idx, steps), from each lowest node to its root.

    ``n`` is the tree's number of lowest nodes; ``idx`` runs from 0 to n - 1.
    """
    nodes = staged(nodes.withColumn("top", _height().cast("int")))
    highest = nodes.agg(F.max("top")).first()[0] or 0
    level, roots, hops, made = nodes.withColumn("m", F.col("n")), [], [], [nodes]
    for at in range(highest + 1):
        roots.append(level.where(F.col("top") == at).select("tree", "digest", "n"))
        if at == highest:
            break
        run = F.shiftright("idx", FANOUT_BITS).alias("idx")
        runs = level.where(F.col("top") > at).groupBy("tree", run, "n", "m", "top").agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        runs = staged(runs.withColumn("joined", _joined(F.col("kids"))).select("tree", "idx", "n", _halved("m").alias("m"), "top", "joined", sha256(hex_text(F.col("joined"))).alias("digest")))
        made.append(runs)
        kid = runs.withColumn("pos", F.explode(F.sequence(F.lit(0), (F.length("joined") / DIGEST - 1).cast("int"))))
        hops.append(kid.select("tree", F.lit(at).alias("level"), (F.shiftleft("idx", FANOUT_BITS) + F.col("pos")).alias("idx"), "n", "top", F.lit(at + 1).alias("at"), F.array(_step(F.col("joined"), F.col("pos"))).alias("steps")))
        level = runs.drop("joined")
    lone = nodes.where("top = 0").select("tree", "idx", F.expr(f"cast(array() as array<{_STEP}>)").alias("steps"))
    roots = staged(reduce(DataFrame.union, roots))
    if not hops:
        return roots, staged(lone)
    pointers, distance = staged(reduce(DataFrame.union, hops)), 1
    while distance < highest:
        onward = staged(_jump(pointers, distance))
        drop_staged(pointers)
        pointers, distance = onward, 2 * distance
    paths = staged(pointers.where("level = 0").select("tree", "idx", "steps").union(lone))
    drop_staged(pointers, *made)
    return roots, paths


def _jump(pointers: DataFrame, distance: int) -> DataFrame:
    """Pointers ``distance`` levels up become pointers twice as far, or to the root."""
    shift = FANOUT_BITS * distance
    asking = pointers.where("at < top").withColumn("anc", F.shiftright("idx", shift)).withColumn("lane", F.shiftright("idx", LANE_BITS))
    width = F.expr(f"shiftright(n + shiftleft(1L, {FANOUT_BITS} * below) - 1, {FANOUT_BITS} * below)")  # nodes on the level that asks
    last = F.least(F.shiftleft(F.col("idx") + 1, shift), width) - 1
    lanes = F.sequence(F.shiftright(F.shiftleft("idx", shift), LANE_BITS), F.shiftright(last, LANE_BITS))
    asked = pointers.where(F.col("level") >= distance).withColumn("below", F.col("level") - distance)
    asked = asked.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("idx").alias("i"), F.col("at").alias("next"), F.col("steps").alias("more"), F.explode(lanes).alias("k"))
    same = (F.col("tree") == F.col("t")) & (F.col("at") == F.col("l")) & (F.col("anc") == F.col("i")) & (F.col("lane") == F.col("k"))
    moved = asking.join(asked, same)
    moved = moved.select("tree", "level", "idx", "n", "top", F.col("next").alias("at"), F.concat("steps", "more").alias("steps"))
    return pointers.where("at = top").union(moved)


def merkle_proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", claim: Column | None = None) -> DataFrame:
    """doc_id, group, leaf, claim, subroot, root, steps: the manifest's leaves and their proofs, one for each row of ``docs``.

    Digests are binary; ``steps`` is an array of (left, right) siblings from the leaf to the root, empty where the
    table is one row. ``claim`` is worked out from the row and passed on beside its leaf (default: the leaf), so that
    ``fold(claim, steps)`` tells whether it is the row that the manifest holds.

    Null fields differ from empty ones; a null group is a group and stands first, a null id stands first in its group. Rows
    with one id stand in order of their digests; repeated rows are leaves of their own. Texts count whole, whatever
    their length. Other columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    leaf = leaf_digest(*[F.col(f) for f in fields])
    leaves = docs.select(F.col(order).cast("long").alias("doc_id"), F.col(group).cast("string").alias("grp"), leaf.alias("leaf"), (leaf if claim is None else claim).alias("claim"))
    leaves = staged(leaves.withColumn("tie", F.monotonically_increasing_id()))  # equal rows spread over the ranges
    by = [F.col("grp").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    placed = staged(leaves.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("id", F.monotonically_increasing_id()))

    # A row's place in its group: rows of the group in ranges before, and before it in its range.
    ranges = staged(placed.groupBy(F.shiftright("id", 33).alias("part"), "grp").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    names = global_index(ranges.select("grp").distinct(), F.col("grp").asc_nulls_first(), out="tree")
    names = names.select(F.col("grp").alias("name"), F.col("tree").cast("long").alias("tree"))
    ahead = Window.partitionBy("grp").orderBy("part")
    ranges = ranges.withColumn("before", F.sum("rows").over(ahead) - F.col("rows")).withColumn("n", F.sum("rows").over(Window.partitionBy("grp")))
    ranges = ranges.join(names, F.col("grp").eqNullSafe(F.col("name"))).select(F.col("part").alias("p"), F.col("name"), "tree", "first", "before", "n")
    rows = placed.join(ranges, (F.shiftright(placed["id"], 33) == ranges["p"]) & placed["grp"].eqNullSafe(ranges["name"]))
    place = F.col("before") + F.col("id") - F.col("first")
    kids = F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col("leaf").alias("digest"), "doc_id", "claim"))).alias("kids")
    runs = rows.groupBy("tree", F.shiftright(place, FANOUT_BITS).alias("idx"), "grp", "n").agg(kids)
    runs = staged(runs.withColumn("joined", _joined(F.col("kids"))))
    alone = F.col("n") == 1  # the leaf is the subroot
    digest = F.when(alone, F.col("joined")).otherwise(sha256(hex_text(F.col("joined"))))
    roots, paths = _paths(runs.select("tree", "idx", digest.alias("digest"), _halved("n").alias("n")))

    groups = roots.count()
    tops, ways = _paths(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(groups).cast("long").alias("n")))
    root = tops.first()  # one digest
    tops = roots.join(ways.select(F.col("idx").alias("tree"), F.col("steps").alias("over")), "tree")
    tops = tops.select(F.col("tree").alias("t"), F.col("digest").alias("subroot"), F.lit(bytes(root["digest"]) if root else b"").alias("root"), "over", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, LANE_BITS))).alias("lane"))
    paths = paths.join(tops, (F.col("tree") == F.col("t")) & (F.shiftright("idx", LANE_BITS) == F.col("lane")))
    paths = paths.select("tree", "idx", "subroot", "root", F.concat("steps", "over").alias("steps"))
    out = runs.join(paths, ["tree", "idx"]).select("*", F.posexplode("kids").alias("pos", "kid"))
    steps = F.when(alone, F.col("steps")).otherwise(F.concat(F.array(_step(F.col("joined"), F.col("pos"))), F.col("steps")))
    return out.select("kid.doc_id", F.col("grp").alias("group"), F.col("kid.digest").alias("leaf"), "kid.claim", "subroot", "root", steps.alias("steps"))
