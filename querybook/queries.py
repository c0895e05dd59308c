"""One callable (spark, sf_dir) -> DataFrame per registered query."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.config import COVISIT, DEFAULTS, TYPES, CovisitSpec
from sessionlens.functions import lists as L
from sessionlens.functions import vectors as V
from sessionlens.functions.columns import round6, stable_hash
from sessionlens.operators import candidates as G
from sessionlens.operators import features as X
from sessionlens.operators import metrics as M
from sessionlens.operators import factors, increments, models
from sessionlens.operators import sampling as S
from sessionlens.operators.boosting import Boost, Boosted
from sessionlens.operators.covisit import covisit, session_tail
from sessionlens.operators.distance import session_item_distance
from sessionlens.operators.neighbours import item_knn, item_knn_cells, item_knn_lsh
from sessionlens.operators.ranking import dense_index
from sessionlens.operators.submission import fold_ensemble, submission
from sessionlens.operators.timeline import with_positions
from sessionlens.plans import feature_table as FT
from sessionlens.plans import generators as P
from sessionlens.plans import ranking as R
from sessionlens.sources import tables
from sessionlens.sources.sinks import stage_path, staged, write_score_chunks
from sessionlens.sources.testbed import BASKET_WINDOW_MS, LABEL_DAYS, Testbed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BASKET_SPEC = CovisitSpec(BASKET_WINDOW_MS, "recency")
VECTOR_SIZE = 64
GBT_ROUNDS = 50  # the default of BoostedRanker; the validation fold stops earlier


def query(fn: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Testbed(spark, sf_dir))
    return fn


# ---- sources -------------------------------------------------------------------------------


@query
def interactions(t: Testbed) -> DataFrame:
    return tables.describe(t.interactions(), DEFAULTS.day_offset_hours)


@query
def session_items(t: Testbed) -> DataFrame:
    return t.test().select("session", "aid")


@query
def labels_long(t: Testbed) -> DataFrame:
    return tables.explode_labels(t.nested_labels())


@query
def day_num(t: Testbed) -> DataFrame:
    return X.day_numbers(t.test())


@query
def session_sequences(t: Testbed) -> DataFrame:
    """Item sequences of any length as rows (session, pos, aid), on the long basket sessions."""
    return with_positions(t.baskets()).select("session", "pos", "aid")


@query
def recent_unique_items(t: Testbed) -> DataFrame:
    return G.recent_unique_items(t.test())


@query
def features_compact(t: Testbed) -> DataFrame:
    return X.compact(candidate_features(t))


# ---- co-visitation -------------------------------------------------------------------------


@query
def session_tail_rows(t: Testbed) -> DataFrame:
    return session_tail(t.train())


QUERIES["session_tail"] = QUERIES.pop("session_tail_rows")


@query
def session_tail_baskets(t: Testbed) -> DataFrame:
    return session_tail(t.baskets())


@query
def covisit_clicks(t: Testbed) -> DataFrame:
    return covisit(t.train(), "clicks")


@query
def covisit_carts_orders(t: Testbed) -> DataFrame:
    return covisit(t.train(), "carts_orders")


@query
def covisit_buy2buy(t: Testbed) -> DataFrame:
    return covisit(t.train(), "buy2buy")


@query
def covisit_clicks_baskets(t: Testbed) -> DataFrame:
    return covisit(t.baskets(), spec=BASKET_SPEC)


@query
def covisit_by_increments(t: Testbed) -> DataFrame:
    """The clicks matrix kept up over the log: its first days at once, the last six one by one."""
    log = t.events().where(~F.col("day").between(*LABEL_DAYS)).select("session", "aid", "ts", "type", "day")
    log, spec, path = staged(log), COVISIT["clicks"], stage_path(t.spark)
    ends = log.agg(F.max("day"), F.floor(F.min("ts") / 1000), F.floor(F.max("ts") / 1000)).first()
    for day in range(ends[0] - 6, ends[0] + 1):
        own = F.col("day") <= day if day == ends[0] - 6 else F.col("day") == day
        increments.add_day(path, day, log.where(own), spec)
    return increments.covisit_kept(t.spark, path, spec, (ends[1], ends[2]))


# ---- candidates ----------------------------------------------------------------------------


@query
def suggest_clicks(t: Testbed) -> DataFrame:
    return G.suggest_clicks(t.test(), covisit(t.train(), "clicks"))


@query
def suggest_buys(t: Testbed) -> DataFrame:
    train = t.train()
    return G.suggest_buys(t.test(), covisit(train, "carts_orders"), covisit(train, "buy2buy"))


@query
def candidates_by_type(t: Testbed) -> DataFrame:
    return P.covisit_candidates(t.train(), t.test())


@query
def popular_candidates(t: Testbed) -> DataFrame:
    return FT.Stats(t.test()).popular


@query
def list_candidates(t: Testbed) -> DataFrame:
    return tables.explode_candidates(G.nest(suggest_clicks(t)))


@query
def covisit_rank_pivot(t: Testbed) -> DataFrame:
    return G.covisit_rank_pivot(candidates_by_type(t))


@query
def knn_vote_candidates(t: Testbed) -> DataFrame:
    return G.suggest_clicks(t.test(), P.vector_neighbours(t.test(), t.vectors()))


@query
def last_item_candidates(t: Testbed) -> DataFrame:
    return G.last_item_candidates(t.test(), P.vector_neighbours(t.test(), t.vectors()))


@query
def sequence_candidates(t: Testbed) -> DataFrame:
    return P.sequence_job(t.train(), t.test())


def _sources(t: Testbed) -> list[DataFrame]:
    return P.candidate_sources(t.train(), t.test(), t.vectors())


@query
def candidate_union(t: Testbed) -> DataFrame:
    return FT.candidate_union(FT.Stats(t.test()), _sources(t))


# ---- features ------------------------------------------------------------------------------


@query
def session_day_counts(t: Testbed) -> DataFrame:
    return X.session_day_counts(FT.Stats(t.test()).totals)


@query
def session_stats(t: Testbed) -> DataFrame:
    return FT.Stats(t.test()).sessions


@query
def session_funnel(t: Testbed) -> DataFrame:
    return X.session_funnel(FT.Stats(t.test()).totals)


@query
def item_stats(t: Testbed) -> DataFrame:
    return FT.Stats(t.test()).items


@query
def item_funnel(t: Testbed) -> DataFrame:
    return X.item_funnel(FT.Stats(t.test()).totals)


@query
def daily_item_rank(t: Testbed) -> DataFrame:
    return X.daily_item_rank(FT.Stats(t.test()).base)


@query
def item_rank_by_day(t: Testbed) -> DataFrame:
    return X.item_rank_by_day(FT.Stats(t.test()).base)


def _rounded_recency(events: DataFrame) -> DataFrame:
    rows = X.session_recency(events)
    scores = ("log_recency_score", "type_weighted_log_recency_score")
    return rows.withColumns({c: round6(F.col(c)) for c in scores})


@query
def session_recency(t: Testbed) -> DataFrame:
    return _rounded_recency(t.test())


@query
def session_recency_baskets(t: Testbed) -> DataFrame:
    return _rounded_recency(t.baskets())


@query
def session_item_stats(t: Testbed) -> DataFrame:
    return X.session_item_stats(t.test())


@query
def candidate_features(t: Testbed) -> DataFrame:
    return FT.candidate_features(FT.Stats(t.test()), _sources(t))


def _with_scores(features: DataFrame, t: Testbed) -> DataFrame:
    """Features and the five distance scores of each row."""
    features = staged(features)
    scores = session_item_distance(features, t.test(), t.vectors())
    return features.join(scores, ["session", "aid"], "left")


@query
def features_with_scores(t: Testbed) -> DataFrame:
    """The scores go through their files: written in chunks of sessions and read back."""
    spark, features = t.spark, staged(candidate_features(t))
    path = stage_path(spark)
    write_score_chunks(session_item_distance(features, t.test(), t.vectors()), path)
    return features.join(tables.read_scores(spark, path), ["session", "aid"], "left")


# ---- vectors -------------------------------------------------------------------------------


@query
def item_knn_all(t: Testbed) -> DataFrame:
    return item_knn(t.vectors())


QUERIES["item_knn"] = QUERIES.pop("item_knn_all")


@query
def item_knn_lsh_all(t: Testbed) -> DataFrame:
    return item_knn_lsh(t.vectors())


QUERIES["item_knn_lsh"] = QUERIES.pop("item_knn_lsh_all")


@query
def item_knn_cells_all(t: Testbed) -> DataFrame:
    return item_knn_cells(t.vectors())


QUERIES["item_knn_cells"] = QUERIES.pop("item_knn_cells_all")


@query
def session_item_distances(t: Testbed) -> DataFrame:
    return session_item_distance(candidates_by_type(t), t.test(), t.vectors())


QUERIES["session_item_distance"] = QUERIES.pop("session_item_distances")


def _scored_pairs(t: Testbed, left: str, right: str, pairs: DataFrame) -> DataFrame:
    """Score of each distinct pair, worked out once however often it occurs."""
    distinct = pairs.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    a = t.vectors().select(F.col("aid").alias(left), F.col("vector").alias("va"))
    b = t.vectors().select(F.col("aid").alias(right), F.col("vector").alias("vb"))
    met = distinct.join(a, left).join(b, right)
    return met.select(left, right, "n", V.dot(F.col("va"), F.col("vb")).alias("score"))


@query
def pair_score(t: Testbed) -> DataFrame:
    scored = _scored_pairs(t, "aid", "aid_next", G.next_item_pairs(t.train()))
    return scored.withColumn("score", round6(F.col("score")))


@query
def pair_negatives(t: Testbed) -> DataFrame:
    return S.pair_negatives(G.next_item_pairs(t.train()), batch_size=500).drop("ts")


@query
def pair_accuracy(t: Testbed) -> DataFrame:
    """Share of true next items scored above one half and of wrong ones scored below."""
    pairs = S.pair_negatives(G.next_item_pairs(t.train()), batch_size=500)
    right = _scored_pairs(t, "aid", "aid_next", pairs).select("n", (V.sigmoid(F.col("score")) > 0.5).alias("ok"))
    wrong = _scored_pairs(t, "aid", "aid_wrong", pairs).select("n", (V.sigmoid(F.col("score")) < 0.5).alias("ok"))
    both = right.unionByName(wrong)
    good = F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0))
    return both.agg(F.sum("n").alias("scored"), round6(good / F.sum("n")).alias("accuracy"))


@query
def embedding_wide(t: Testbed) -> DataFrame:
    return t.vectors().select("aid", *V.wide(F.col("vector"), VECTOR_SIZE, "embedding"))


@query
def zip_explode(t: Testbed) -> DataFrame:
    """Parallel lists of a session unpacked in lock-step."""
    near = last_item_candidates(t)
    pairs = F.array_sort(F.collect_list(F.struct("rank", "aid")))  # at most 20 per session
    packed = near.groupBy("session").agg(pairs.alias("p"))
    packed = packed.select("session", F.col("p.aid").alias("aid"), F.col("p.rank").alias("rank"))
    return packed.select("session", F.inline(F.arrays_zip("aid", "rank")))


# ---- training data -------------------------------------------------------------------------


def _candidates(t: Testbed) -> DataFrame:
    return staged(FT.candidate_keys(FT.Stats(t.test()), _sources(t)))


@query
def labeled_candidates(t: Testbed) -> DataFrame:
    return S.labeled_candidates(_candidates(t), t.labels(), "clicks")


def _joined(t: Testbed) -> DataFrame:
    return S.join_labels(_candidates(t), t.labels())


@query
def target_sessions(t: Testbed) -> DataFrame:
    return S.target_sessions(_joined(t), "carts")


@query
def positive_list(t: Testbed) -> DataFrame:
    joined = _joined(t)
    return S.positive_list(joined, S.target_sessions(joined, "orders"), "orders")


@query
def negative_sample(t: Testbed) -> DataFrame:
    joined = _joined(t)
    return S.negative_list(joined, S.target_sessions(joined, "carts"), "carts")


def _training_set(type_: str) -> Callable[[Testbed], DataFrame]:
    """Keys first, then features for those only."""

    def build(t: Testbed) -> DataFrame:
        stats, sources = FT.Stats(t.test()), FT.together(_sources(t))
        keys = staged(S.training_keys(staged(FT.candidate_keys(stats, sources)), t.labels(), type_))
        return FT.candidate_features(stats, sources, keys)

    return build


for _type in TYPES:
    QUERIES[f"train_set_{_type}"] = (
        lambda spark, sf_dir, build=_training_set(_type): build(Testbed(spark, sf_dir))
    )


@query
def global_negative_sample(t: Testbed) -> DataFrame:
    """Five negatives to a positive: fewer than there are."""
    return S.global_negative_sample(labeled_candidates(t), per_positive=5)


@query
def class_balance(t: Testbed) -> DataFrame:
    return S.class_balance(labeled_candidates(t))


@query
def session_sample(t: Testbed) -> DataFrame:
    return S.session_sample(t.train(), n=200, seed=42)


@query
def folds(t: Testbed) -> DataFrame:
    dealt = S.folds(t.test()).groupBy("session", "fold")
    return dealt.agg(F.count(F.lit(1)).alias("session_length"))


@query
def row_shuffle(t: Testbed) -> DataFrame:
    return S.shuffled_rows(G.next_item_pairs(t.train()), "session", "pos", seed=3)


@query
def next_item_pairs(t: Testbed) -> DataFrame:
    return G.next_item_pairs(t.train())


@query
def next_item_pairs_baskets(t: Testbed) -> DataFrame:
    return G.move_counts(t.baskets())


@query
def pair_holdout(t: Testbed) -> DataFrame:
    return S.pair_holdout(t.train(), n=1000)


@query
def ratio_split(t: Testbed) -> DataFrame:
    return S.ratio_split(t.train())


@query
def kcore_filter(t: Testbed) -> DataFrame:
    return S.kcore_round(t.test())


@query
def kcore_fixpoint(t: Testbed) -> DataFrame:
    """On the baskets, where it takes several passes."""
    return S.kcore(t.baskets(), min_session=20, min_item=20)


@query
def padded_sequences(t: Testbed) -> DataFrame:
    """Last 20 items as internal ids (1, 2, ...), 0 as padding."""
    index = dense_index(t.train(), "aid", start=1)
    tail = G.sequence_tail(t.test()).join(index, "aid")
    ordered = L.ordered_list(-F.col("back"), F.col("idx"))  # at most 20 per session
    packed = tail.groupBy("session").agg(ordered.alias("ids"))
    padded = L.pad_right(F.col("ids"), DEFAULTS.history_tail)
    return packed.select("session", L.join_text(padded).alias("aid_list"), F.size("ids").cast("long").alias("item_length"))


@query
def interaction_matrix(t: Testbed) -> DataFrame:
    return S.interaction_matrix(t.interactions())


@query
def item_index(t: Testbed) -> DataFrame:
    return dense_index(t.baskets(), "aid")


@query
def item_cardinality(t: Testbed) -> DataFrame:
    pairs = G.next_item_pairs(t.train())
    highest = F.greatest(F.max("aid"), F.max("aid_next"))
    return pairs.agg((highest + 1).alias("n_items"))


# ---- metrics and output --------------------------------------------------------------------


def _labelled_candidates(t: Testbed) -> DataFrame:
    """Candidates of the sessions that the metric looks at."""
    wanted = t.labels().select("session").distinct()
    return P.covisit_candidates(t.train(), t.test().join(wanted, "session", "left_semi"))


@query
def recall_at_k(t: Testbed) -> DataFrame:
    return M.recall_at_k(_labelled_candidates(t), t.labels())


@query
def recall_total(t: Testbed) -> DataFrame:
    return M.recall_total(recall_at_k(t))


@query
def metric_rows(t: Testbed) -> DataFrame:
    return M.metric_rows(recall_at_k(t))


@query
def session_recall(t: Testbed) -> DataFrame:
    return M.session_recall(_labelled_candidates(t), t.labels(), 20)


@query
def recall_pred_driven(t: Testbed) -> DataFrame:
    return M.recall_of_predicted(candidates_by_type(t), t.labels())


@query
def ndcg_at_20(t: Testbed) -> DataFrame:
    return M.ndcg_at_k(_labelled_candidates(t), t.labels())


def _fold_scores(t: Testbed) -> DataFrame:
    """Stand-in for the scores of five fold models: repeatable noise on the inverse rank."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(DEFAULTS.folds - 1)))
    rows = candidates_by_type(t).withColumn("fold", fold)
    noise = stable_hash(F.col("session"), F.col("aid"), F.col("fold")) % 1_000_003 / F.lit(1e6).cast("double")
    return rows.select("session", "aid", "type", "fold", round6(F.lit(1.0) / F.col("rank") + noise).alias("score"))


@query
def fold_ensemble_scores(t: Testbed) -> DataFrame:
    return fold_ensemble(_fold_scores(t))


QUERIES["fold_ensemble"] = QUERIES.pop("fold_ensemble_scores")


@query
def submission_rows(t: Testbed) -> DataFrame:
    return submission(fold_ensemble(_fold_scores(t)))


QUERIES["submission"] = QUERIES.pop("submission_rows")




@query
def auc(t: Testbed) -> DataFrame:
    """Of the fold means against the labels, per type."""
    hits = t.labels().withColumn("gt", F.lit(1))
    rows = fold_ensemble(_fold_scores(t)).join(hits, ["session", "type", "aid"], "left")
    return M.auc(rows.withColumn("gt", F.coalesce("gt", F.lit(0))), "type")


# ---- models: SQL says which rows they must return, and that each has a finite result -----------


def _finite(score: str) -> Column:
    return (F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))).alias("finite")


def _finite_vector(size: int) -> Column:
    ok = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (ok & (F.size("vector") == size)).alias("finite")


def _well_ranked(candidates: DataFrame) -> DataFrame:
    """A row for each session: whether its ranks run from 1 without gaps and its items are distinct."""
    n, items = F.count(F.lit(1)), F.count_distinct("aid")
    ok = (F.min("rank") == 1) & (F.max("rank") == n) & (items == n)
    return candidates.groupBy("session").agg(ok.alias("ok"))


@query
def w2v_candidates(t: Testbed) -> DataFrame:
    near = P.vector_neighbours(t.test(), models.window_vectors(t.interactions()))
    return _well_ranked(G.suggest_clicks(t.test(), near))


@query
def window_pair_counts(t: Testbed) -> DataFrame:
    return models.window_pairs(t.baskets())


@query
def mf_candidates(t: Testbed) -> DataFrame:
    near = P.vector_neighbours(t.test(), models.next_item_factors(t.interactions()))
    return _well_ranked(G.last_item_candidates(t.test(), near))


@query
def als_embeddings(t: Testbed) -> DataFrame:
    _, items = models.interaction_factors(S.interaction_matrix(t.train()))
    return items.select("aid", _finite_vector(16))


@query
def features_with_session_emb(t: Testbed) -> DataFrame:
    sessions, _ = models.interaction_factors(S.interaction_matrix(t.test()), rank=10)
    rows = models.with_session_embeddings(session_item_stats(t), sessions, 10)
    parts = [F.col(f"session_embedding{i}") for i in range(10)]
    finite = F.forall(F.array(*parts), lambda x: x.isNotNull() & ~F.isnan(x)).alias("finite")
    return rows.select("session", "aid", finite)


_KEPT: dict[tuple, dict[str, DataFrame]] = {}
_FITTED: dict[tuple, Boosted] = {}
RANKERS = Boost(patience=20)


def _there(table: DataFrame) -> bool:
    """Whether a staged table still is where it was written."""
    spark, files = table.sparkSession, table.inputFiles()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0]) if files else None
    return target is None or target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _kept(t: Testbed, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Staged tables that several queries of a session read; made again if they were dropped."""
    key = (t.spark.sparkContext.applicationId, t.root, name)
    if key not in _KEPT or not all(_there(x) for x in _KEPT[key].values()):
        _KEPT[key] = make()
    return _KEPT[key]


def _near_pairs(t: Testbed) -> DataFrame:
    """How often items of the log stand near each other, both orders."""
    pairs = models.window_pairs(t.train())
    return staged(pairs.union(pairs.select("aid_near", "aid", "n")).groupBy("aid", "aid_near").agg(F.sum("n").alias("n")))


@query
def skip_gram_cells(t: Testbed) -> DataFrame:
    return factors.shifted_pmi(_near_pairs(t))


@query
def skip_gram_factors(t: Testbed) -> DataFrame:
    """How much of the matrix 32 factors hold: no less than their share of all, no more than all."""
    cells = staged(factors.shifted_pmi(_near_pairs(t)))
    parts = factors.factorised(cells, 32).select(F.posexplode("vector").alias("k", "v")).groupBy("k").agg(F.pow(F.sum(F.col("v") * F.col("v")), F.lit(2)).alias("held"))
    held = parts.agg(F.sum("held").alias("held")).first()["held"] or 0.0
    whole = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("aid").alias("items"), F.sum(F.col("pmi") * F.col("pmi")).alias("norm"))
    share = F.least(F.lit(1.0), F.lit(32.0) / F.col("items"))
    return whole.select("cells", "items", F.round("norm", 3).alias("norm"), (F.lit(held).between(F.col("norm") * share * 0.999, F.col("norm") * 1.001)).alias("fits"))


def _learned(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Of pairs (key, other), the share that scores above the same key with the partner of another pair, against 0.55: one half is chance."""
    pairs = staged(dense_index(pairs.select(F.struct(key, other).alias("pair")).distinct(), "pair", out="i")).select("i", "pair.*")
    n = pairs.count()
    wrong = pairs.select((F.pmod(F.col("i") + n // 2, F.lit(n))).alias("i"), F.col(other).alias("wrong"))
    rows = pairs.join(wrong, "i").join(left.select(key, F.col("vector").alias("l")), key)
    for name, out in ((other, "r"), ("wrong", "w")):
        rows = rows.join(right.select(F.col(right.columns[0]).alias(name), F.col("vector").alias(out)), name)
    above = V.dot(F.col("l"), F.col("r")) > V.dot(F.col("l"), F.col("w"))
    return rows.select(above.alias("above")).agg(F.count(F.lit(1)).alias("pairs"), (F.avg(F.col("above").cast("int")) > 0.55).alias("learned"))


@query
def warp_factors(t: Testbed) -> DataFrame:
    matrix_ = S.interaction_matrix(t.train()).select("session", "aid")
    sessions, items = factors.warp_vectors(matrix_, epochs=5)
    return _learned(matrix_, sessions, items, "session", "aid")


@query
def next_item_factors(t: Testbed) -> DataFrame:
    moves = staged(G.move_counts(t.train()).withColumnRenamed("moves", "n"))
    vectors, _ = factors.pair_vectors(moves, epochs=5)
    return _learned(moves, vectors, vectors, "aid", "aid_next")


def _ranker_tables(t: Testbed) -> dict[str, DataFrame]:
    return _kept(t, "training", lambda: _made_ranker_tables(t))


def _made_ranker_tables(t: Testbed) -> dict[str, DataFrame]:
    """Training rows of each objective: sampled keys, then features and distance scores for those only.

    What two objectives share is worked out once.
    """
    stats, sources = FT.Stats(t.test()), FT.together(_sources(t))
    candidates = staged(FT.candidate_keys(stats, sources))
    keys = {type_: staged(S.training_keys(candidates, t.labels(), type_)) for type_ in TYPES}
    wanted = staged(reduce(DataFrame.unionByName, [k.select("session", "aid") for k in keys.values()]).distinct())
    features = staged(_with_scores(FT.candidate_features(stats, sources, wanted), t))
    return {type_: staged(features.join(k.select("session", "aid"), ["session", "aid"], "left_semi")) for type_, k in keys.items()}


@query
def ranker_rows(t: Testbed) -> DataFrame:
    rows = S.labeled_candidates(_ranker_tables(t)["carts"], t.labels(), "carts")
    return S.folds(rows)


def _candidate_order(training: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """The training rows scored by their place in the co-visitation list of the objective, which a model has to beat."""
    parts = []
    for type_, rows in training.items():
        rows = R.labelled(rows, labels, type_).withColumn("score", -F.col(f"covisit_{type_}_candidate_num"))
        parts.append(rows.select("session", "aid", F.lit(type_).alias("type"), "gt", "score"))
    return reduce(DataFrame.unionByName, parts)


def _against_order(scored: DataFrame, training: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """Held-out rows with the NDCG of the candidate order, and whether that of the scores is above it, by type."""
    order = R.held_out_ndcg(_candidate_order(training, labels)).withColumnRenamed("ndcg", "order_ndcg")
    mine = R.held_out_ndcg(scored).withColumnRenamed("ndcg", "_mine")
    both = order.join(mine, "type").select("type", "order_ndcg", (F.col("_mine") > F.col("order_ndcg")).alias("above"))
    rows = scored.select("session", "aid", "type", F.col("fold").cast("long").alias("fold"), F.col("gt").cast("long").alias("gt"), _finite("score"))
    return rows.join(F.broadcast(both), "type")  # three rows


LEAST_AUC = 0.6  # of held-out rows; one half is no better than chance


def _held_out(t: Testbed, make: Callable[[], object]) -> DataFrame:
    """Out-of-fold results of all five folds of all objectives, and whether the AUC of each objective says the model learned something."""
    training = _ranker_tables(t)
    fitted = R.fit_types(training, t.labels(), make, R.feature_names(training["clicks"]))
    parts = [scored.withColumn("type", F.lit(type_)) for type_, pairs in fitted.items() for _, scored in pairs]
    rows = staged(reduce(DataFrame.unionByName, parts))
    learned = M.auc(rows, "type").select("type", (F.col("auc") > LEAST_AUC).alias("learned"))
    rows = rows.select("session", "aid", "type", "fold", F.col("gt").cast("long").alias("gt"), _finite("score"))
    return rows.join(F.broadcast(learned), "type")  # three rows


@query
def rank_gbt_reg(t: Testbed) -> DataFrame:
    return _held_out(t, lambda: models.BoostedRanker(rounds=GBT_ROUNDS))


@query
def rank_gbt_clf(t: Testbed) -> DataFrame:
    return _held_out(t, lambda: models.BoostedRanker(binary=True, rounds=GBT_ROUNDS))


@query
def rank_pairwise(t: Testbed) -> DataFrame:
    return _held_out(t, models.PairwiseRanker)


@query
def rank_ndcg(t: Testbed) -> DataFrame:
    return _held_out(t, lambda: models.PairwiseRanker(ndcg=DEFAULTS.submit_k))


def _boosted(t: Testbed) -> tuple[Boosted, DataFrame]:
    """The list-wise rankers and their held-out scores, fitted once for the queries that look at them."""
    key = (t.spark.sparkContext.applicationId, t.root)

    def make() -> dict[str, DataFrame]:
        training = _ranker_tables(t)
        _FITTED[key], scored = R.boosted(training, t.labels(), R.feature_names(training["clicks"]), RANKERS)
        return {"scored": scored}

    scored = _kept(t, "held out", make)["scored"]
    return _FITTED[key], scored


@query
def rank_lambda(t: Testbed) -> DataFrame:
    """The list-wise ranker, held out."""
    return _against_order(_boosted(t)[1], _ranker_tables(t), t.labels())


@query
def lambda_root_split(t: Testbed) -> DataFrame:
    """The first split of each model: feature, bin and gain, and the training rows on both sides."""
    training = _ranker_tables(t)
    fitted, _ = R.boosted(training, t.labels(), R.feature_names(training["clicks"]), Boost(rounds=1, depth=1))
    rows = [(type_, fold, fitted.names[f], cut, gain, left, right) for (type_, fold), (f, cut, gain, left, right) in fitted.first_splits.items()]
    return t.spark.createDataFrame(rows, "type string, fold long, feature string, bin long, gain double, rows_left long, rows_right long")


@query
def boosting_curve(t: Testbed) -> DataFrame:
    """Of each model's curve of NDCG by round: the best round is the first highest, and the rounds end where patience does."""
    fitted, _ = _boosted(t)
    settings, curve = fitted.settings, fitted.curve(t.spark)
    highest = F.max(F.struct("ndcg", (-F.col("round")).alias("back")))["back"]
    best = F.max(F.when(F.col("best"), F.col("round")))
    models_ = curve.groupBy("type", F.col("fold").cast("long").alias("fold")).agg((best == -highest).alias("best_is_highest"), F.max("round").alias("rounds"), best.alias("best"), (F.count_if(F.col("best")) == 1).alias("one_best"))
    stop = F.col("rounds") == F.least(F.lit(settings.rounds), F.col("best") + settings.patience)
    return models_.select("type", "fold", "best_is_highest", "one_best", stop.alias("stops"))


def _recalls(recalls: DataFrame, training: dict[str, DataFrame], labels: DataFrame, beats: bool = True) -> DataFrame:
    """Recall of the candidate order by type and fold, and whether the model's is not below it over all folds (or just is a recall)."""
    order = _candidate_order(training, labels)
    folds_ = [S.folds(rows).select("session", "fold").distinct().withColumn("type", F.lit(type_)) for type_, rows in training.items()]
    order = staged(order.join(reduce(DataFrame.unionByName, folds_), ["session", "type"]))
    base = R.out_of_fold_recalls(order, labels, TYPES).select("type", "fold", F.col("recall").alias("order_recall"), F.col("hits").alias("order_hits"))
    above = F.col("fold").isNotNull() | (F.col("hits") >= F.col("order_hits")) if beats else F.col("hits").between(0, F.col("gt_count"))
    return recalls.join(base.withColumnRenamed("fold", "_fold").withColumnRenamed("type", "_type"), (recalls["type"] == F.col("_type")) & recalls["fold"].eqNullSafe(F.col("_fold"))).select("type", F.col("fold").cast("long").alias("fold"), "gt_count", "order_recall", above.alias("above" if beats else "ok"))


@query
def cv_recall(t: Testbed) -> DataFrame:
    """Of the linear ranker, which is below the candidate order for carts."""
    training = _ranker_tables(t)
    _, recalls = R.cross_validate(training, t.labels(), models.PairwiseRanker, R.feature_names(training["clicks"]))
    return _recalls(recalls, training, t.labels(), beats=False)


@query
def cv_recall_lambda(t: Testbed) -> DataFrame:
    training, (_, scored) = _ranker_tables(t), _boosted(t)
    return _recalls(R.out_of_fold_recalls(scored, t.labels(), TYPES), training, t.labels())


def _well_formed(lists: DataFrame) -> DataFrame:
    aids = F.split("labels", " ")
    return lists.select("session_type", F.size(aids).cast("long").alias("n"), (F.size(F.array_distinct(aids)) == F.size(aids)).alias("distinct"))


@query
def submission_of_models(t: Testbed) -> DataFrame:
    """Fifteen fitted rankers on all candidates: fold mean, best 20, submission rows."""
    training = _ranker_tables(t)
    names = R.feature_names(training["clicks"])
    fitted = R.fit_types(training, t.labels(), models.PairwiseRanker, names)
    every = staged(_with_scores(candidate_features(t), t))
    return _well_formed(R.predict(every, {type_: [m for m, _ in pairs] for type_, pairs in fitted.items()}, names))


@query
def submission_of_lambda(t: Testbed) -> DataFrame:
    """The same by the list-wise rankers, in one pass over the features."""
    fitted, _ = _boosted(t)
    return _well_formed(R.predict(staged(_with_scores(candidate_features(t), t)), fitted, fitted.names))
