"""Language identification: text, declared language, address suffix and host, fused by Bayes' rule.

The languages are those declared in the table itself, once at least, whatever its size; texts in a language that nobody
declares are in no known language, or in one much like it. Each has a model of letter trigrams, counted over all
documents that declare it; a document counts by shares, so long ones don't outweigh the others. The text's
likelihood then names a first guess for every document, and grouped counts of these guesses say what the other
evidence is worth here: how often a language is declared as what, what each address suffix holds, and what each
host holds. A host's prior is smoothed by its domain's, that by the prior of all documents. A document's own guess
is taken out of the counts before they are used on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import keyed, mixed, same_document, slices, text_key, unpacked
from sessionlens.sources.sinks import staged

BUCKETS = 8192
BLOCK = 128  # languages whose counts the driver, or a task while counting, holds at a time
CELLS = 1 << 20  # of rows x languages that are fused at a time
FULL = 400  # trigrams that count in full; longer texts count as much
TEMPER = 0.25  # neighbouring trigrams say much the same
ALPHA = 20.0  # guesses that a broader prior is worth
CERTAIN = 0.5
ENOUGH = 20  # trigrams from which a text can be in no known language

_LETTER = np.zeros(256, np.uint64)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_LETTER[65:91] = np.arange(97, 123)


def trigram_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hash buckets of its letter trigrams and how often they occur.

    Letters are a-z, in either case, and all bytes beyond ASCII; a run of others is one gap.
    """
    for text in texts.cast(pa.large_binary()).to_pylist():
        letters = _LETTER[np.frombuffer(text or b"", np.uint8)]
        letters = letters[(letters > 0) | np.r_[letters[1:] > 0, False]] if len(letters) else letters
        x = np.r_[np.uint64(0), letters, np.uint64(0)]
        codes = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
        codes = codes[x[1:-1] > 0]
        counts = np.bincount((mixed(codes) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=1)
        at = np.flatnonzero(counts)
        yield at, counts[at]


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        total: dict[int, np.ndarray] = {}

        def counted() -> pa.RecordBatch:
            each = [(i, np.flatnonzero(sums), sums) for i, sums in total.items()]
            whole = [np.concatenate([x, *parts]) for x, parts in (
                (np.zeros(0, np.int64), [np.full(len(at), i) for i, at, _ in each]),
                (np.zeros(0, np.int64), [at for _, at, _ in each]),
                (np.zeros(0), [sums[at] for _, at, sums in each]),
            )]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in whole], ["language", "bucket", "n"])

        for batch in slices(batches, 1024):
            for language, (at, n) in zip(batch.column("declared").to_pylist(), trigram_counts(batch.column("text"))):
                if len(n) and language in place:
                    if place[language] not in total and len(total) >= BLOCK:
                        yield counted()
                        total.clear()
                    total.setdefault(place[language], np.zeros(BUCKETS))[at] += n * (min(FULL, n.sum()) / n.sum())
        yield counted()

    return run


def _score(models: list[Broadcast[np.ndarray]], languages: int):
    """Per row the tempered log likelihood of each language, the number of trigrams, the first guess."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found, counts, mean = [], [], []
            for at, n in trigram_counts(batch.column("text")):
                total = int(n.sum())
                each = np.concatenate([n @ model.value[at] for model in models]) / max(total, 1)
                found.append(each * min(total, FULL) * TEMPER)
                counts.append(total)
                mean.append(float(each.max()) if total else 0.0)
            likelihood = np.array(found).reshape(len(found), -1)
            guess = [int(x.argmax()) if n else None for x, n in zip(likelihood, counts)]
            flat = pa.array(likelihood.ravel())
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * languages)
            keep = [batch.column(c) for c in ("doc_id", "key", "declared", "suffix", "host")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.ListArray.from_arrays(ends, flat), pa.array(counts, pa.int64()), pa.array(mean), pa.array(guess, pa.int32())],
                ["doc_id", "key", "declared", "suffix", "host", "likelihood", "trigrams", "mean", "guess"],
            )

    return run


def address_host(url: Column) -> Column:
    """The host of an address, in lower case; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\w[\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def address_suffix(host: Column) -> Column:
    """The last part of a host name; null for a host without a dot."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def markup_language(html: Column) -> Column:
    """The language that the html tag of a page declares, without its region; null if none."""
    tag = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def _counts(rows: DataFrame, by: str, alias: str) -> DataFrame:
    """A row for each value of ``by``: the languages guessed there and how often each was."""
    each = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias(f"_{by}"), "guess").agg(F.count("*").cast("double").alias("n"))
    return each.groupBy(f"_{by}").agg(F.collect_list(F.struct("guess", "n")).alias("x")).select(
        f"_{by}", F.col("x.guess").alias(alias), F.col("x.n").alias(f"{alias}_n")
    )


def _fuse(n: int, overall: np.ndarray, declared_total: np.ndarray, declared_kinds: int, suffix_total: np.ndarray, suffix_kinds: int, names: list[str]):
    """Posterior of each row, from the counts joined to it, less its own guess."""

    def table(frame: pd.DataFrame, level: str, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = np.array([x is not None for x in frame[level]])
        counts = np.zeros((len(frame), n))
        for i, (at, times) in enumerate(zip(frame[level], frame[f"{level}_n"])):
            if at is not None:
                counts[i, at] = times
        return np.where(have[:, None], counts - own, 0.0), have

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CELLS // n)
        for frame in (whole[i : i + step].reset_index(drop=True) for whole in frames for i in range(0, len(whole), step)):
            own = np.zeros((len(frame), n))
            guessed = frame["guess"].notna().to_numpy()
            own[np.flatnonzero(guessed), frame["guess"][guessed].astype(int)] = 1
            prior = (overall - own + 1) / (overall.sum() - own.sum(1, keepdims=True) + n)
            for level in ("in_domain", "in_host"):
                counts, _ = table(frame, level, own)
                prior = (counts + ALPHA * prior) / (counts.sum(1, keepdims=True) + ALPHA)
            log = np.stack(frame["likelihood"].to_numpy()) + np.log(prior)
            for level, total, kinds in (("as_declared", declared_total, declared_kinds), ("in_suffix", suffix_total, suffix_kinds)):
                counts, have = table(frame, level, own)
                log += np.where(have[:, None], np.log((counts + 1) / np.maximum(total - own + kinds, 1)), 0.0)
            log -= log.max(1, keepdims=True)
            post = np.exp(log)
            post /= post.sum(1, keepdims=True)
            best = post.argmax(1)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "key": frame["key"], "language": [names[i] for i in best],
                "probability": post.max(1), "trigrams": frame["trigrams"], "mean": frame["mean"],
            })

    return run


def identify_language(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None
) -> DataFrame:
    """doc_id, key, language, probability, reason of every row of ``docs``; ``reason`` is null where it is accepted.

    Rejected are texts without letters (null and empty ones included; "no text"), texts of 20 trigrams or more that
    fit no language better than chance ("unknown language"), and those whose best language has a probability
    below 1/2 ("unsure"). Every declared language has a model, of 8 bytes x 8192 in a task. Missing evidence, null or a column that is None, says nothing. A table that declares no
    language at all rejects every row, with a null language. Repeated rows stay repeated and get the same result.
    Other columns are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession

    def column(name: str | None) -> Column:
        return F.col(name).cast("string") if name else F.lit(None).cast("string")

    only = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"),
        column(declared).alias("declared"), column(suffix).alias("suffix"), column(host).alias("host"),
    )
    lettered = F.col("text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")
    found = only.where(F.col("declared").isNotNull() & lettered).select("declared").distinct()
    languages = [r[0] for r in found.orderBy("declared").collect()]
    n = len(languages)
    if not n:
        reason = F.when(lettered, "unsure").otherwise("no text")
        return only.select("doc_id", "key", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), reason.alias("reason"))
    counted = only.mapInArrow(_count(languages), "language long, bucket long, n double")
    sums = staged(counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")))  # languages x buckets
    models = []
    for first in range(0, n, BLOCK):
        counts = np.zeros((BUCKETS, min(BLOCK, n - first)))
        some = sums.where(F.col("language").between(first, first + BLOCK - 1)).toPandas()
        counts[some["bucket"], some["language"] - first] = some["n"]
        models.append(spark.sparkContext.broadcast(np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))))

    schema = "doc_id long, key long, declared string, suffix string, host string, likelihood array<double>, trigrams long, mean double, guess int"
    rows = staged(only.mapInArrow(_score(models, n), schema))
    rows = rows.withColumn("domain", F.substring_index("host", ".", -2))
    guesses = rows.where("guess is not null")
    kinds = guesses.agg(F.approx_count_distinct("declared").alias("declared"), F.approx_count_distinct("suffix").alias("suffix")).first()
    totals = guesses.groupBy("guess").agg(F.count("*").alias("all"), F.count("declared").alias("declared"), F.count("suffix").alias("suffix")).collect()
    overall, as_declared, in_suffix = np.zeros((3, n))
    for r in totals:
        overall[r["guess"]], as_declared[r["guess"]], in_suffix[r["guess"]] = r["all"], r["declared"], r["suffix"]
    for by, alias in (("host", "in_host"), ("domain", "in_domain"), ("declared", "as_declared"), ("suffix", "in_suffix")):
        if by in ("host", "domain") and not host or by == "declared" and not declared or by == "suffix" and not suffix:
            rows = rows.withColumn(alias, F.lit(None).cast("array<int>")).withColumn(f"{alias}_n", F.lit(None).cast("array<double>"))
        else:
            table = staged(_counts(guesses, by, alias))
            rows = rows.join(table, F.col(by) == F.col(f"_{by}"), "left").drop(f"_{by}")
    fuse = _fuse(n, overall, as_declared, max(1, kinds["declared"]), in_suffix, max(1, kinds["suffix"]), languages)
    out = rows.mapInPandas(fuse, "doc_id long, key long, language string, probability double, trigrams long, mean double")
    unknown = (F.col("trigrams") >= ENOUGH) & (F.col("mean") < -float(np.log(BUCKETS)))
    reason = F.when(F.col("trigrams") == 0, "no text").when(unknown, "unknown language").when(F.col("probability") < CERTAIN, "unsure")
    return out.select("doc_id", "key", "language", F.round("probability", 9).alias("probability"), reason.alias("reason"))


def keep_identified(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", declared: str | None = "lang", host: str | None = "source") -> DataFrame:
    """The rows of ``docs`` that identification accepts, with all their columns as they are."""
    gone = identify_language(docs, text, doc_id, declared, host).where("reason is not null")
    rows, gone = keyed(docs, text, doc_id), staged(gone.select("doc_id", "key").distinct())
    return unpacked(rows.join(gone, same_document(rows, gone), "left_anti"))
