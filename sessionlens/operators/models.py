"""Estimators on MLlib: embeddings for candidates and rankers for the final lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.config import UNRANKED
from sessionlens.functions.columns import stable_hash
from sessionlens.operators.candidates import move_counts
from sessionlens.operators.ranking import HOT_KEYS, dealt, dense_index
from sessionlens.operators.timeline import numbered, with_positions
from sessionlens.sources.sinks import staged

VECTOR = "vector"


# ---- embeddings ----------------------------------------------------------------------------


PART_PAIRS = 2_000_000


def window_pairs(events: DataFrame, window: int = 25) -> DataFrame:
    """How often an item stands within ``window`` places after another in a session (aid, aid_near, n).

    Places are cut in blocks of ``window``; a block and the next one make a list of two windows at most, in which every row of the block
    finds its followers. The work is linear in events and a long session spreads over as many keys as it has blocks.
    Followers travel as a list for each row, to as many parts as they ask for. Pairs of an item with 1/HOT_KEYS of all rows, of which
    few differ or one part would get too many, are counted before the shuffle.
    """
    placed = staged(with_positions(events).select("session", "pos", "aid"))
    rows, low, high = placed.agg(F.count(F.lit(1)), F.min("aid"), F.max("aid")).first()
    often = placed.groupBy("aid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_KEYS >= rows).collect()  # HOT_KEYS rows at most
    usual = rows - sum(r["n"] for r in often)
    narrow = "int" if low is not None and -(2**31) <= low and high < 2**31 else "long"

    block = F.floor(F.col("pos") / window)
    near = placed.select("session", F.explode(F.array(block, block - 1)).alias("block"), "pos", "aid").where("block >= 0")
    near = dealt(near, "session", "block", count=2 * rows)
    lists = near.groupBy("session", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "aid"))).alias("all"))  # 2 x window at most
    each = lists.select("block", "all", F.posexplode("all").alias("i", "at")).where(F.floor(F.col("at.pos") / window) == F.col("block"))
    after = F.transform(F.slice("all", F.col("i") + 2, window), lambda x: x["aid"].cast(narrow))
    each = each.select(F.col("at.aid").alias("aid"), after.alias("after")).where(F.size("after") > 0)

    def counted(some: DataFrame) -> DataFrame:
        pairs = some.select("aid", F.explode("after").alias("aid_near")).withColumn("aid_near", F.col("aid_near").cast("long"))
        return pairs.groupBy("aid", "aid_near").agg(F.count(F.lit(1)).alias("n"))

    ids = [r["aid"] for r in often if r["aid"] is not None]
    is_hot = F.when(F.col("aid").isNull(), F.lit(len(ids) < len(often))).otherwise(F.col("aid").isin(ids) if ids else F.lit(False))
    spread = counted(each.where(~is_hot).repartition(max(1, -(-usual * window // PART_PAIRS)), "aid")) if usual else None
    if spread is None:
        return counted(each)
    return spread.unionByName(counted(each.where(is_hot))) if often else spread


def window_vectors(
    events: DataFrame, size: int = 32, window: int = 25, epochs: int = 10, seed: int = 42, blocks: int = 10
) -> DataFrame:
    """Item vectors (aid, vector) from which items stand near each other, in either order."""
    pairs = window_pairs(events, window)
    both = pairs.union(pairs.select("aid_near", "aid", "n")).groupBy("aid", "aid_near").agg(F.sum("n").alias("n"))
    by_item, _ = _factors(both, "aid", "aid_near", "n", size, epochs, seed, blocks)
    return by_item


def _factors(
    matrix: DataFrame, user: str, item: str, weight: str, rank: int, epochs: int, seed: int, blocks: int
) -> tuple[DataFrame, DataFrame]:
    """Implicit-feedback factors (user, vector) and (item, vector), worked out in ``blocks`` parts of each.

    Ids are mapped to dense ints, as MLlib asks for; more than 2^31 users or items are an error of the cast.
    """
    users = dense_index(matrix, user, out="_u")
    items = dense_index(matrix, item, out="_i")
    rows = matrix.join(users, user).join(items, item)
    rows = rows.select(F.col("_u").cast("int"), F.col("_i").cast("int"), F.col(weight).cast("float").alias("_w"))
    learner = ALS(
        rank=rank,
        maxIter=epochs,
        implicitPrefs=True,
        userCol="_u",
        itemCol="_i",
        ratingCol="_w",
        seed=seed,
        checkpointInterval=10,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
    )
    model = learner.fit(rows)
    by_user = model.userFactors.join(users, F.col("id") == F.col("_u")).select(user, F.col("features").alias(VECTOR))
    by_item = model.itemFactors.join(items, F.col("id") == F.col("_i")).select(item, F.col("features").alias(VECTOR))
    return by_user, by_item


def interaction_factors(
    matrix: DataFrame, rank: int = 16, epochs: int = 10, seed: int = 42, blocks: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Session and item vectors from the (session, aid, n) matrix."""
    return _factors(matrix, "session", "aid", "n", rank, epochs, seed, blocks)


def next_item_factors(
    events: DataFrame, rank: int = 32, epochs: int = 10, seed: int = 42, blocks: int = 10
) -> DataFrame:
    """Item vectors (aid, vector) from how often one item follows another."""
    by_item, _ = _factors(move_counts(events), "aid", "aid_next", "moves", rank, epochs, seed, blocks)
    return by_item


def session_embedding_columns(vectors: DataFrame, size: int) -> DataFrame:
    return vectors.select("session", *[F.col(VECTOR)[i].alias(f"session_embedding{i}") for i in range(size)])


def with_session_embeddings(features: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Features plus the vector of their session, one column per component."""
    return features.join(session_embedding_columns(vectors, size), "session", "left")


# ---- rankers -------------------------------------------------------------------------------


def _filler(name: str) -> float:
    if name.endswith(("_candidate_num", "_rank")) or "_rank_day" in name:
        return float(UNRANKED)
    return 0.0 if "_cnt" in name or name.endswith("_unique_aid") else -1.0


def numeric_features(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Features without NULLs and a flag for each value that was missing (trees here reject NULL)."""
    values = [F.coalesce(F.col(n).cast("double"), F.lit(_filler(n))).alias(n) for n in names]
    flags = [F.col(n).isNull().cast("double").alias(f"{n}_missing") for n in names if df.schema[n].nullable]
    return values + flags


def vectorised(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and one dense feature vector, in column ``features``."""
    numbers = numeric_features(df, names)
    plain = df.select(*keep, *numbers)
    inputs = [c for c in plain.columns if c not in keep]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(plain).select(*keep, "features")


class PairwiseRanker:
    """Linear ranker: a positive should score above a negative of its session.

    Each negative is set against one positive, picked by hash, so the number of training pairs is
    the number of negatives and not positives times negatives. With ``ndcg`` a second fit weighs a pair by
    what swapping its rows would change in NDCG at ``ndcg``, in the order of the first fit.
    """

    def __init__(self, epochs: int = 50, reg: float = 0.01, ndcg: int | None = None):
        self.learner = LogisticRegression(maxIter=epochs, regParam=reg, fitIntercept=False)
        self.ndcg = ndcg

    @staticmethod
    def pairs(rows: DataFrame, ndcg: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """(label, features, weight); weights are 1, or come from the column ``place`` of the rows. ``keep`` names columns
        of the negative that its pair keeps; with ``row`` among them, that of the positive is kept as ``pos_row``."""
        rows = rows if ndcg else rows.withColumn("place", F.lit(1))
        rows = rows.withColumn("_gain", PairwiseRanker._gain(ndcg or 1))
        other = {"row": "pos_row"} if "row" in keep else {}
        positives = rows.filter(F.col("gt") == 1)
        counts = positives.groupBy("session").agg(F.count(F.lit(1)).alias("_p"))
        by_id = numbered(positives.select("session", "aid", F.col("features").alias("_pos"), F.col("_gain").alias("_pos_gain"), *[F.col(a).alias(b) for a, b in other.items()]), "aid")
        positives = by_id.select("session", F.col("pos").alias("_at"), "_pos", "_pos_gain", *other.values())
        negatives = rows.filter(F.col("gt") == 0).join(counts, "session")
        h = stable_hash(F.col("session"), F.col("aid"), seed=17)
        at = F.pmod(F.shiftright(h, 1), F.col("_p")).alias("_at")
        negatives = negatives.select("session", at, F.col("features").alias("_neg"), "_gain", h.alias("_h"), *keep)
        met = negatives.join(positives, ["session", "_at"])
        sign = F.when(F.col("_h") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        gap = F.zip_with(vector_to_array("_pos"), vector_to_array("_neg"), lambda p, n: p - n)
        weight = F.lit(1.0) if ndcg is None else F.abs(F.col("_pos_gain") - F.col("_gain")) + 1e-3
        keep = [*keep, *other.values()]
        signed = met.select(sign.alias("_s"), gap.alias("_g"), weight.alias("weight"), *keep)
        return signed.select(
            (F.col("_s") > 0).cast("double").alias("label"),
            array_to_vector(F.expr("transform(_g, x -> x * _s)")).alias("features"),
            "weight",
            *keep,
        )

    @classmethod
    def shared(cls, rows: DataFrame) -> DataFrame:
        """The pairs of all folds: a pair lies in one session, and a session in one fold."""
        return cls.pairs(rows, keep=[c for c in ("fold", "row") if c in rows.columns])

    @staticmethod
    def _gain(k: int) -> Column:
        """What the place of a row is worth in NDCG at ``k``."""
        return F.when(F.col("place") <= k, F.lit(1.0) / F.log2(F.col("place") + 1)).otherwise(0.0)

    def reweighed(self, pairs: DataFrame, rows: DataFrame, rankers: Sequence[PairwiseRanker]) -> DataFrame:
        """The ``shared`` pairs with ``weight0``, ``weight1``, ...: what they weigh in the order of the first fit of each fold.

        The pairs do not depend on that order, so they are made once, and only narrow rows meet to weigh them. ``rows`` and pairs
        have the id ``row``. The weight of a fold's model is NULL in the fold that it holds out.
        """
        scored = rows.select("session", "aid", "fold", "row", "features")
        for i, ranker in enumerate(rankers):
            scored = ranker.score(scored).withColumnRenamed("score", f"score{i}")
        each = F.inline(F.array(*[F.struct(F.lit(i).alias("model"), F.col(f"score{i}").alias("score")) for i in range(len(rankers))]))
        tall = scored.select("session", "aid", "fold", "row", each).where(F.col("fold") != F.col("model"))
        order = W.partitionBy("session", "model").orderBy(F.desc("score"), F.asc("aid"))
        placed = tall.withColumn("place", F.row_number().over(order)).withColumn("gain", self._gain(self.ndcg))
        gains = staged(placed.groupBy("row").agg(*[F.max(F.when(F.col("model") == i, F.col("gain"))).alias(f"gain{i}") for i in range(len(rankers))]))
        partners = gains.select(F.col("row").alias("pos_row"), *[F.col(f"gain{i}").alias(f"pos_gain{i}") for i in range(len(rankers))])
        both = pairs.select("row", "pos_row").join(gains, "row").join(partners, "pos_row")
        weights = both.select("row", *[(F.abs(F.col(f"pos_gain{i}") - F.col(f"gain{i}")) + 1e-3).alias(f"weight{i}") for i in range(len(rankers))])
        return pairs.drop("weight").join(weights, "row")

    def fit_pairs(self, pairs: DataFrame, weighted: bool = False) -> PairwiseRanker:
        self.model = (self.learner.copy({self.learner.weightCol: "weight"}) if weighted else self.learner).fit(pairs)
        return self

    def fit(self, train: DataFrame, valid: DataFrame | None = None, pairs: DataFrame | None = None) -> PairwiseRanker:
        """``pairs``: those of the training rows, if they are there already."""
        self.fit_pairs(self.pairs(train) if pairs is None else pairs)
        if self.ndcg:
            order = W.partitionBy("session").orderBy(F.desc("score"), F.asc("aid"))
            placed = self.score(train).withColumn("place", F.row_number().over(order)).drop("score")
            self.fit_pairs(self.pairs(placed, self.ndcg), weighted=True)
        return self

    def weights(self) -> list[float]:
        """The score of a row is the sum of its features times these."""
        return self.model.coefficients.toArray().tolist()

    def score(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(rows)
        return scored.withColumn("score", vector_to_array("rawPrediction")[1]).drop(
            "rawPrediction", "probability", "prediction"
        )


class BoostedRanker:
    """Boosted trees on 0/1 labels, by squared error or by log loss.

    With validation rows, rounds stop when the validation error no longer improves; ``best_round`` is the
    number of rounds kept.
    """

    def __init__(
        self,
        binary: bool = False,
        rounds: int = 50,
        depth: int = 6,
        step: float = 0.1,
        rows: float = 0.8,
        cols: float = 0.8,
        seed: int = 42,
    ):
        common = dict(
            maxIter=rounds,
            maxDepth=depth,
            stepSize=step,
            subsamplingRate=rows,
            featureSubsetStrategy=str(cols),
            seed=seed,
            labelCol="gt",
        )
        self.binary = binary
        self.learner = GBTClassifier(**common) if binary else GBTRegressor(**common)

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> BoostedRanker:
        rows = train.withColumn("_valid", F.lit(False))
        learner = self.learner
        if valid is not None:
            rows = rows.unionByName(valid.select(train.columns).withColumn("_valid", F.lit(True)))
            learner = learner.copy({learner.validationIndicatorCol: "_valid"})
        self.model = learner.fit(rows)
        self.best_round = self.model.getNumTrees
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(rows)
        if not self.binary:
            return scored.withColumnRenamed("prediction", "score")
        return scored.withColumn("score", vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction"
        )
