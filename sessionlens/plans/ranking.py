"""Cross-validated training, out-of-fold evaluation and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from sessionlens.config import DEFAULTS
from sessionlens.functions.columns import round6
from sessionlens.functions.vectors import matrix
from sessionlens.operators import metrics as M
from sessionlens.operators import sampling as S
from sessionlens.operators.boosting import Boost, Boosted, fit_boosted
from sessionlens.operators.models import vectorised
from sessionlens.operators.submission import fold_ensemble, submission, top_items
from sessionlens.sources.sinks import drop_staged, staged

KEYS = ("session", "aid")
FIT_ROWS = 2_000_000  # rows of the fits that run side by side: MLlib keeps a copy of those of each


def feature_names(df: DataFrame) -> list[str]:
    """All columns but keys and label."""
    return [c for c in df.columns if c not in (*KEYS, "gt", "type", "fold")]


def prepared(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Training rows as vectors with their fold and a number, ``row``, written out once for the many passes that follow."""
    return staged(S.folds(vectorised(rows, names, [*KEYS, "gt"])).withColumn("row", F.monotonically_increasing_id()))


def fit_folds(
    rows: DataFrame, make: Callable[[], object], n: int = DEFAULTS.folds, single: bool = False
) -> list[tuple[object, DataFrame]]:
    """(model, scored held-out rows) per fold; only the first fold if ``single``.

    Folds are fitted side by side as far as they have FIT_ROWS rows together, else one after the other. What a
    ranker makes of the rows of all folds alike (``shared``) is made and written once; so are the weights of a second fit, where
    the rows are numbered.
    """
    shared = staged(make().shared(rows)) if hasattr(make(), "shared") else None
    twice = shared is not None and "pos_row" in shared.columns and make().ndcg

    def one(fold: int) -> object:
        held, own = rows.filter(F.col("fold") == fold), F.col("fold") != fold
        more = {} if shared is None else {"pairs": shared.filter(own).drop("fold")}
        return make().fit_pairs(more["pairs"]) if twice else make().fit(rows.filter(own), held, **more)

    folds_, most = range(1 if single else n), FIT_ROWS // max(1, rows.count())
    fitted = _side_by_side(rows, one, folds_, most)
    if twice:
        weighed = staged(fitted[0].reweighed(shared, rows, fitted))

        def again(fold: int) -> object:
            pairs = weighed.filter(F.col("fold") != fold).select("label", "features", F.col(f"weight{fold}").alias("weight"))
            return fitted[fold].fit_pairs(pairs, weighted=True)

        _side_by_side(rows, again, folds_, most)
        drop_staged(weighed)
    if shared is not None:
        drop_staged(shared)
    return [(model, model.score(rows.filter(F.col("fold") == fold)).select(*KEYS, "gt", "fold", "score")) for fold, model in zip(folds_, fitted)]


def _side_by_side(df: DataFrame, work: Callable, items: Sequence, most: int) -> list:
    with ThreadPoolExecutor(max(1, min(most, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(df.sparkSession)(work), items))


def out_of_fold_recall(scored: Sequence[DataFrame], labels: DataFrame, type_: str) -> DataFrame:
    """Recall at 20 of the held-out rows, by fold and pooled (fold NULL)."""
    rows = reduce(DataFrame.unionByName, scored).withColumn("type", F.lit(type_))
    truth = labels.filter(F.col("type") == type_)
    best = top_items(rows).select("session", "type", "aid", "rank")
    per_session = M.session_recall(best, truth, DEFAULTS.submit_k)
    per_session = per_session.join(rows.select("session", "type", "fold").distinct(), ["session", "type"])
    sums = per_session.cube("fold").agg(F.sum("hits").alias("hits"), F.sum("gt_count").alias("gt_count"))
    recall = round6(F.col("hits") / F.col("gt_count")).alias("recall")
    return sums.select(F.lit(type_).alias("type"), "fold", "hits", "gt_count", recall)


def auc(scored: DataFrame) -> float:
    rows = scored.select(F.col("gt").cast("double").alias("label"), F.col("score").alias("rawPrediction"))
    return BinaryClassificationEvaluator().evaluate(rows)


def cross_validate(
    training: dict[str, DataFrame],
    labels: DataFrame,
    make: Callable[[], object],
    names: Sequence[str],
    single: bool = False,
) -> tuple[dict[str, list], DataFrame]:
    """Models per type and the out-of-fold recalls of all types."""
    fitted = fit_types(training, labels, make, names, single)
    models = {type_: [m for m, _ in pairs] for type_, pairs in fitted.items()}
    recalls = [out_of_fold_recall([s for _, s in pairs], labels, type_) for type_, pairs in fitted.items()]
    return models, reduce(DataFrame.unionByName, recalls)


def labelled(rows: DataFrame, labels: DataFrame, type_: str) -> DataFrame:
    """Rows with gt = 1.0 where they are a label of the objective, else 0.0."""
    hits = labels.filter(F.col("type") == type_).select(*KEYS, F.lit(1.0).alias("gt"))
    return rows.join(hits, list(KEYS), "left").withColumn("gt", F.coalesce("gt", F.lit(0.0)))


def boosted(training: dict[str, DataFrame], labels: DataFrame, names: Sequence[str], settings: Boost = Boost()) -> tuple[Boosted, DataFrame]:
    """Boosted models of all types and folds, grown together, and their scores of held-out rows."""
    made = _side_by_side(labels, lambda type_: staged(S.folds(labelled(training[type_], labels, type_))), list(training), len(training))
    rows = dict(zip(training, made))
    fitted, lists = fit_boosted(rows, names, settings, DEFAULTS.folds)
    return fitted, staged(fitted.held_out(lists))


def out_of_fold_recalls(scored: DataFrame, labels: DataFrame, types: Sequence[str]) -> DataFrame:
    """``out_of_fold_recall`` of each type of scored rows (session, aid, type, fold, score)."""
    parts = [out_of_fold_recall([scored.filter(F.col("type") == t)], labels, t) for t in types]
    return reduce(DataFrame.unionByName, parts)


def held_out_ndcg(scored: DataFrame, k: int = DEFAULTS.submit_k) -> DataFrame:
    """(type, ndcg) of rows (session, aid, type, gt, score) over the sessions that have positives."""
    truth = scored.filter(F.col("gt") == 1).select("session", "type", "aid")
    return M.ndcg_at_k(top_items(scored, k).select("session", "type", "aid", "rank"), truth, k).select("type", "ndcg")


def fit_types(
    training: dict[str, DataFrame],
    labels: DataFrame,
    make: Callable[[], object],
    names: Sequence[str],
    single: bool = False,
) -> dict[str, list[tuple[object, DataFrame]]]:
    """(model, scored held-out rows) of every fold of every type; types are worked on side by side if they are small."""

    made = _side_by_side(labels, lambda type_: prepared(labelled(training[type_], labels, type_), names), list(training), len(training))
    rows = dict(zip(training, made))
    at_once = len(rows) if DEFAULTS.folds * sum(df.count() for df in rows.values()) <= FIT_ROWS else 1
    return dict(zip(rows, _side_by_side(labels, lambda type_: fit_folds(rows[type_], make, single=single), list(rows), at_once)))


def fold_scores(features: DataFrame, models: dict[str, list] | Boosted, names: Sequence[str]) -> DataFrame:
    """Scores of every fold model on all rows (session, aid, type, fold, score), in one pass over the features.

    Linear models are rows of one matrix that a batch is multiplied with; boosted ones walk their trees on
    one binned batch. Other models are scored one by one.
    """
    if isinstance(models, Boosted):
        return models.fold_scores(features)
    rows = vectorised(features, names, KEYS)
    every = [(type_, i, model) for type_, fitted in models.items() for i, model in enumerate(fitted)]
    if all(hasattr(model, "weights") for _, _, model in every):
        weights = np.array([model.weights() for _, _, model in every])
        wide = rows.select(*KEYS, vector_to_array("features").alias("x"))
        scores = wide.mapInArrow(_linear_kernel(weights), "session long, aid long, scores array<double>")
        names_ = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(i).alias("fold")) for t, i, _ in every])
        return scores.select(*KEYS, F.inline(F.zip_with(names_, "scores", lambda m, s: F.struct(m["type"].alias("type"), m["fold"].alias("fold"), s.alias("score")))))
    scored = [model.score(rows).select(*KEYS, F.lit(t).alias("type"), F.lit(i).alias("fold"), "score") for t, i, model in every]
    return reduce(DataFrame.unionByName, scored)


def _linear_kernel(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = matrix(batch.column("x")) @ weights.T if batch.num_rows else np.zeros((0, len(weights)))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(weights))
            yield pa.RecordBatch.from_arrays([batch.column("session"), batch.column("aid"), pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))], ["session", "aid", "scores"])

    return run


def predict(features: DataFrame, models: dict[str, list] | Boosted, names: Sequence[str]) -> DataFrame:
    """Final lists: fold mean, best 20 per session and type, as submission rows."""
    return submission(fold_ensemble(fold_scores(features, models, names)))
