"""Alignment of two tokenizers over a corpus, by products of sparse incidence matrices.

Both tokenizers cut the same bytes. Row i of the token-byte matrix A holds the bytes of token i; with B for the other
tokenizer, A * B^T holds how many bytes two tokens share. Matrices are kept as compressed rows (CSR) and multiplied row
by row (Gustavson): the rows of the right factor that a row of the left one names are added up.

Where a token and the last token it overlaps end at one byte, a group ends. With rows summed by id, the incidence of
A's ids and groups times that of groups and B's ids holds how often two ids share a group in a document, without
listing the pairs of a group one by one. All documents of a batch are one block-diagonal matrix.

How many documents of the corpus link a pair of ids is a grouped count. Reading it back, the most frequent pairs (as many
as ``FREQUENT``, by a threshold from the histogram of counts) are looked up in the tasks; the rest, rare and so never
a hot key, meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import flat, list_array, slices
from sessionlens.sources.sinks import drop_staged, staged

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
FREQUENT = 1 << 19  # pairs of ids sent to the tasks, 13 bytes each
BATCH_CHARS = 1 << 19
_TERMS = 1 << 21  # terms of a product at a time


@dataclass
class Rows:
    """A sparse matrix by compressed rows: row i has values[starts[i]:starts[i + 1]] in columns[...], in order."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, height: int, values: np.ndarray | None = None) -> Rows:
        """From entries in any order; entries of one place are added up."""
        values = np.ones(len(rows), np.int64) if values is None else values
        if not ((rows[1:] > rows[:-1]) | ((rows[1:] == rows[:-1]) & (columns[1:] >= columns[:-1]))).all():
            order = np.lexsort((columns, rows))
            rows, columns, values = rows[order], columns[order], values[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])][: len(rows)])
        rows, columns = rows[first], columns[first]
        values = np.add.reduceat(values, first) if len(first) else values
        return cls(np.r_[0, np.cumsum(np.bincount(rows, minlength=height))], columns, values)

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def times(self, right: Rows) -> Rows:
        """The product, row by row; ``_TERMS`` terms are in memory at a time, or those of one entry's row."""
        entries = self.row_numbers()
        terms = np.diff(right.starts)[self.columns]
        before = np.r_[0, np.cumsum(terms)]
        out, at = [], 0
        while at < len(entries):
            to = max(at + 1, int(np.searchsorted(before, before[at] + _TERMS, "right")) - 1)
            own = terms[at:to]
            places = np.arange(own.sum()) + np.repeat(right.starts[self.columns[at:to]] - (before[at:to] - before[at]), own)
            part = Rows.of(np.repeat(entries[at:to], own), right.columns[places], len(self.starts) - 1, np.repeat(self.values[at:to], own) * right.values[places])
            if to - at == len(entries):
                return part
            out.append((part.row_numbers(), part.columns, part.values))
            at = to
        if not out:
            return Rows(np.zeros(len(self.starts), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        rows, columns, values = (np.concatenate(x) for x in zip(*out))
        return Rows.of(rows, columns, len(self.starts) - 1, values)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


# Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level tokenizer (JSON); special tokens inside a text are ordinary text.

    Texts of Latin-1 characters go through a faster implementation of the same merges, where the file's ids are in the
    order of its merges; classes of other characters depend on a library's Unicode tables, so those texts
    go through the library the file is made for.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        self.data, letters, special = data, byte_letters(), {t["id"] for t in spec.get("added_tokens", ())}
        vocabulary = spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *special]))
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if i in special else bytes(letters[c] for c in token)
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        plain = merged == list(range(256, 256 + len(merged))) and spec.get("normalizer") is None
        plain = plain and (spec.get("pre_tokenizer") or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
        self.ranks = {self.bytes[i]: i for i in vocabulary.values() if i not in special} if plain else None

    @cached_property
    def tokenizer(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the threads
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.data.decode())
        tokenizer.encode_special_tokens = True
        return tokenizer

    @cached_property
    def fast(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [self.fast.encode_ordinary(" " + t) if self.ranks and _latin(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([" " + texts[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = e.ids
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Pieces:
    """A sentence-piece tokenizer (model), which puts a space in front of a text itself.

    Where no piece has a space behind another character, no merge reaches over the front of a word with its spaces:
    then texts of Latin-1 characters are cut there, and words that come again are looked up.
    """

    KEPT = 1 << 17  # words, and those of one batch

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        self.bytes, pieces = [], []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
                pieces.append(piece)
        apart = self.model.encode("a  b ", out_type=str) == ["▁a", "▁", "▁b", "▁"]
        self.words: dict[str, list[int]] | None = {} if apart and not any("▁" in p.lstrip("▁") for p in pieces) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [re.findall(" +[^ ]*", " " + t) if self.words is not None and _latin(t) else None for t in texts]
        self._look_up([c for c in cut if c is not None])
        return [self.model.encode(t) if c is None else list(chain.from_iterable(map(self.words.__getitem__, c))) for t, c in zip(texts, cut)]

    def _look_up(self, cut: list[list[str]]) -> None:
        """Have the ids of all these words; what was kept before goes when it is too much."""
        new = list(set().union(*cut).difference(self.words)) if cut else []
        if len(self.words) + len(new) > self.KEPT:
            self.words = {}
            new = list(set().union(*cut))
        asked = [w for w in new if len(w) > 1]
        self.words.update(zip(asked, self.model.encode([w[1:] for w in asked], num_threads=1) if asked else ()))
        if len(asked) < len(new):
            self.words[" "] = [self.model.piece_to_id("▁")]


@lru_cache(maxsize=2)
def _tokenizers(first: bytes, second: bytes) -> tuple:
    """Both tokenizers, the sizes of their tokens, and their ids as text after each separator; kept by the worker."""
    both = ByteLevel(first), Pieces(second)
    sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in both]
    texts = [{c: np.array([f"{c}{i}" for i in range(len(t.bytes))], object) for c in ("", ",", ";", "|")} for t in both]
    return both, sizes, texts


class _Side:
    """The tokens of one tokenizer in a batch of documents, one after another."""

    def __init__(self, lists: list[list[int]], sizes: np.ndarray):
        self.ids = np.concatenate([np.asarray(x, np.int64) for x in lists])
        self.ends = np.cumsum(sizes[self.ids])
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.docs = np.repeat(np.arange(len(lists)), self.counts)
        self.starts = np.r_[0, np.cumsum(self.counts)]

    def of_bytes(self) -> Rows:
        """Tokens by bytes."""
        size = int(self.ends[-1])
        return Rows(np.r_[0, self.ends], np.arange(size), np.ones(size, np.int64))

    def by_bytes(self) -> Rows:
        """Bytes by tokens."""
        size = int(self.ends[-1])
        return Rows(np.arange(size + 1), np.repeat(np.arange(len(self.ends)), np.diff(np.r_[0, self.ends])), np.ones(size, np.int64))


def groups_of(a: _Side, b: _Side, overlaps: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides: a group ends where a token and the last one it overlaps end together."""
    last = overlaps.columns[overlaps.starts[1:] - 1]
    closes = a.ends == b.ends[last]
    of_a = np.cumsum(closes) - closes
    return of_a, np.searchsorted(a.ends[closes], b.ends)


def shared_groups(a: _Side, b: _Side, of_a: np.ndarray, of_b: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, A id, B id, links) of a batch; ``width`` is above all A ids."""
    keys, row = np.unique(a.docs * width + a.ids, return_inverse=True)
    product = Rows.of(row, of_a, len(keys)).times(Rows.of(of_b, b.ids, int(of_a[-1]) + 1))
    own = keys[product.row_numbers()]
    return own // width, own % width, product.columns, product.values


def _texts_of(a: _Side, b: _Side, of_a: np.ndarray, of_b: np.ndarray, texts: list[dict]) -> Iterator[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document."""
    groups = np.arange(int(of_a[-1]) + 2)
    cuts = [np.searchsorted(of, groups) for of in (of_a, of_b)]
    parts = np.empty(len(of_a) + len(of_b), object)
    for k, (side, own, other) in enumerate(((a, of_a, cuts[1]), (b, of_b, cuts[0][1:]))):
        words = texts[k][","][side.ids]
        firsts = cuts[k][:-1]
        words[firsts] = texts[k][";|"[k]][side.ids[firsts]]
        if k == 0:
            words[side.starts[:-1]] = texts[0][""][side.ids[side.starts[:-1]]]
        parts[np.arange(len(own)) + other[own]] = words
    ends = a.starts + b.starts
    for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield "".join(parts[start:stop].tolist())


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups string, a array<int>, b array<int>, links array<long>"


def _align(first: bytes, second: bytes, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), sizes, names = _tokenizers(first, second)
        for batch in slices(batches, 512):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                to, chars = at + 1, len(texts[at])
                while to < len(texts) and chars + len(texts[to]) <= BATCH_CHARS:
                    chars, to = chars + len(texts[to]), to + 1
                yield _aligned(batch.column("doc_id").slice(at, to - at), texts[at:to], one, two, sizes, names, whole)
                at = to

    return run


def _aligned(ids: pa.Array, texts: list[str], one: ByteLevel, two: Pieces, sizes: list[np.ndarray], names: list[dict], whole: bool) -> pa.RecordBatch:
    counts, pairs, said = np.zeros((5, len(texts)), np.int64), [[np.empty(0, np.int64)] * len(texts) for _ in range(3)], [""] * len(texts)
    places = [i for i, t in enumerate(texts) if t]
    cut = [t.encode([texts[i] for i in places]) for t in (one, two)]
    same = []
    for k, i in enumerate(places):
        data = b" " + texts[i].encode()
        same.append(all(b"".join([t.bytes[x] for x in lists[k]]) == data for t, lists in zip((one, two), cut)))
    places = [i for i, s in zip(places, same) if s]
    if places:
        a, b = (_Side([x for x, s in zip(lists, same) if s], n) for lists, n in zip(cut, sizes))
        overlaps = a.of_bytes().times(b.by_bytes())
        of_a, of_b = groups_of(a, b, overlaps)
        docs, a_ids, b_ids, links = shared_groups(a, b, of_a, of_b, len(one.bytes))
        groups = np.diff(np.r_[-1, of_a[a.starts[1:] - 1]])
        shared = np.add.reduceat(np.diff(overlaps.starts), a.starts[:-1])
        bounds = np.searchsorted(docs, np.arange(len(places) + 1))
        total = np.add.reduceat(links, bounds[:-1])
        counts[:, places] = a.counts, b.counts, groups, shared, total
        for column, values in zip(pairs, (a_ids, b_ids, links)):
            for i, own in zip(places, np.split(values, bounds[1:-1])):
                column[i] = own
        for i, text in zip(places, _texts_of(a, b, of_a, of_b, names)):
            said[i] = text if whole else hashlib.sha256(text.encode()).hexdigest()
    lists = [list_array(c).cast(pa.list_(t)) for c, t in zip(pairs, (pa.int32(), pa.int32(), pa.int64()))]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in counts], pa.array(said, pa.string()), *lists], [c.split()[0] for c in _ALIGNED.split(", ")])


def align_tokens(docs: DataFrame, first: str = BYTE_LEVEL, second: str = PIECES, text: str = "text", doc_id: str = "doc_id", whole: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups, a, b, links of each row of ``docs``.

    ``a``, ``b`` and ``links`` are arrays in step: ids of both tokenizers that share a group, and how many occurrences do.
    ``groups`` is ``a1,a2|b1;a3|b2,b3``, the ids of each group in order, with ``whole``; else its SHA-256. ``first`` and
    ``second`` are files of a byte-level and a sentence-piece tokenizer that the driver reads and sends to the tasks.

    Both cut a space and the text. Null and empty texts, and texts whose tokens don't give back their bytes, have no
    tokens: zeros, '' and empty arrays. Texts count whole. Rows are aligned one by one, so repeated rows repeat and
    null ids stay null. Other columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    files = [open(path, "rb").read() for path in (first, second)]  # a megabyte or two
    only = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return only.mapInArrow(_align(*files, whole), _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n, best: in how many rows of ``aligned`` a pair of ids is linked, and whether none of its A id is in more."""
    pairs = aligned.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = staged(pairs)
    most = pairs.groupBy(F.col("a").alias("id")).agg(F.max("n").alias("most"))
    return staged(pairs.join(most, pairs["a"] == most["id"]).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def _looked_up(codes: np.ndarray, n: np.ndarray, best: np.ndarray):
    """Adds up what the sorted ``codes`` say about each document's pairs; pairs that aren't there are passed on."""
    names = ["no", "n_best", "count_sum", "a", "b", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            lists = [batch.column(c) for c in ("a", "b", "links")]
            ends = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            a, b, links = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            own = a << 32 | b
            at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
            known = codes[at] == own if len(codes) else np.zeros(len(own), bool)
            sums = []
            for values in (best, n):
                terms = np.r_[0, np.cumsum(np.where(known, links * values[at] if len(codes) else 0, 0))]
                sums.append(terms[ends[1:]] - terms[ends[:-1]])
            rest = np.r_[0, np.cumsum(~known)][ends]
            left = [np.split(x[~known], rest[1:-1]) for x in (a, b, links)]
            yield pa.RecordBatch.from_arrays([batch.column("no"), *[pa.array(s) for s in sums], *[list_array(x) for x in left]], names)

    return run


def alignment_scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``aligned`` without their pairs, with n_best and count_sum.

    ``count_sum`` adds up the counts of a row's links, ``n_best`` counts those whose pair is a best one of its A id.
    """
    rows = staged(aligned.withColumn("no", F.monotonically_increasing_id()))
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).orderBy(F.desc("power")).collect()  # 63 rows at most
    least, total = 1 << 62, 0
    for r in sizes:
        total += r["pairs"]
        if total > FREQUENT:
            break
        least = 1 << r["power"]
    table = counts.where(F.col("n") >= least).select(F.expr("shiftleft(cast(a as long), 32) | b").alias("code"), "n", "best").toArrow().sort_by("code")
    codes, n, best = (flat([c.to_numpy(zero_copy_only=False) for c in table.column(k).chunks], np.int64) for k in range(3))
    found = rows.select("no", "a", "b", "links").mapInArrow(_looked_up(codes, n, best), "no long, n_best long, count_sum long, a array<long>, b array<long>, links array<long>")
    found = staged(found)
    rest = found.select("no", F.inline(F.arrays_zip("a", "b", "links"))).join(counts.where(F.col("n") < least), ["a", "b"])
    rest = rest.groupBy("no").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("best_too"), F.sum(F.col("links") * F.col("n")).alias("sum_too"))
    out = found.select("no", "n_best", "count_sum").join(rest, "no", "left")
    out = out.select("no", (F.col("n_best") + F.coalesce("best_too", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("sum_too", F.lit(0))).alias("count_sum"))
    out = staged(rows.drop("a", "b", "links").join(out, "no").drop("no"))
    drop_staged(rows, found)
    return out
