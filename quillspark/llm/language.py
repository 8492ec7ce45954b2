"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of presence: for each n-gram length the number of
(hashed) character n-grams that both have, divided by the root of the product of how many each has,
summed over the lengths. Landmarks drawn from the training texts give the Nystroem map: with K the
kernel matrix of the landmarks, a text's features are its kernel values to them times K^(-1/2). On
these, ridge regression learns one against the rest for each language. Because the kernel is linear
in a text's scaled presence vector, landmarks, map and weights multiply out to one matrix a length,
and a batch of texts is scored by one (sparse) matrix product a length.

Null texts and texts without a letter are ``und`` with score 0. Rows are kept one for one, repeated
ones too. Texts of any length are read whole. Rows with a null doc_id are neither held out nor learned
from. Without a row to learn from, every text is ``und``. An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import need

UNKNOWN = "und"
LENGTHS = (1, 2, 3, 4)
#: Buckets of each length's n-grams: enough that a text of a million characters leaves most of them empty.
BUCKETS = (1 << 12, 1 << 14, 1 << 17, 1 << 17)
#: Bounds of what is learned from: languages (those with the most texts), texts and landmarks of all of
#: them together, and texts and landmarks of one (those whose hashed doc_id is smallest). Only the
#: numbers of their n-gram buckets reach the driver, of a long text every so many-th bucket number.
LANGUAGES, TEXTS, LANDMARKS = 200, 4_000, 400
PER_LANGUAGE, LANDMARKS_EACH = 240, 48
GRAMS = 4_096
RIDGE = 1e-2
_LETTERLIKE = re.compile(r"[^\W\d_]")  # fractions and raised digits too
_ODD = np.uint32(2654435769)
_ROWS, _MARKS = 128, 32


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


def presence(text: str) -> list[np.ndarray]:
    """For each n-gram length, the sorted buckets that the n-grams of the whole lower-cased text fall in."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    gram, n = np.zeros(len(codes) + 1, np.uint32), 0
    for length, buckets in zip(LENGTHS, BUCKETS, strict=True):
        while n < length:
            gram = gram[:-1] * np.uint32(1000003) + (codes[n:] + np.uint32(1))
            n += 1
        mixed = gram ^ (gram >> np.uint32(15))
        found = (mixed * _ODD) >> np.uint32(32 - buckets.bit_length() + 1)
        if len(found) < 4 * GRAMS:
            found = np.unique(found)
        else:
            held = np.zeros(buckets, bool)
            held[found] = True
            found = np.flatnonzero(held)
        out.append(found.astype(np.int32))
    return out


@dataclass(frozen=True)
class Presence:
    """Presence rows of many texts for one n-gram length, as a sparse matrix of unit rows."""

    buckets: np.ndarray  # of all rows, one after another
    ends: np.ndarray  # one more than rows

    @staticmethod
    def of(rows: list[np.ndarray]) -> Presence:
        n = np.array([len(r) for r in rows], np.int64)
        return Presence(np.concatenate([np.zeros(0, np.int32), *rows]), np.concatenate(([0], np.cumsum(n))))

    def times(self, dense: np.ndarray) -> np.ndarray:
        """The matrix product with ``dense``."""
        n = np.diff(self.ends)
        out = np.zeros((len(n), dense.shape[1]), dense.dtype)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(dense[self.buckets], self.ends[:-1][some], axis=0)
        return out / np.sqrt(np.maximum(n, 1))[:, None].astype(dense.dtype)

    def scattered(self, buckets: int) -> np.ndarray:
        """The transposed matrix, dense."""
        n = np.diff(self.ends)
        out = np.zeros((buckets, len(n)), np.float32)
        out[self.buckets, np.repeat(np.arange(len(n)), n)] = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
        return out


@dataclass(frozen=True)
class KernelModel:
    """Languages, a matrix (buckets, languages) for each n-gram length, and a bias."""

    languages: tuple[str, ...]
    weights: tuple[np.ndarray, ...]
    bias: np.ndarray

    def margins(self, rows: list[list[np.ndarray]]) -> np.ndarray:
        total = np.zeros((len(rows), len(self.languages)), np.float32)
        for k, weights in enumerate(self.weights):
            total += Presence.of([r[k] for r in rows]).times(weights)
        return total + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (softmax of four times the margins) of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        spoken = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for at in range(0, len(spoken), _ROWS):
            part = spoken[at : at + _ROWS]
            margin = 4 * self.margins([presence(texts[i]) for i in part]).astype(float)
            odds = np.exp(margin - margin.max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            scores[part] = 1 / odds.sum(axis=1)
            for i, b in zip(part, best, strict=True):
                names[i] = self.languages[b]
        return names, scores


def fit_kernel(rows: list[list[np.ndarray]], langs: np.ndarray, landmarks: int = LANDMARKS_EACH, ridge: float = RIDGE) -> KernelModel:
    """Nystroem features of the presence ``rows`` and ridge regression of each language."""
    languages = tuple(sorted(set(langs.tolist())))
    if not languages:
        return KernelModel((), tuple(np.zeros((b, 0), np.float32) for b in BUCKETS), np.zeros(0, np.float32))
    each = max(1, min(landmarks, LANDMARKS // len(languages)))
    marks = np.concatenate([np.flatnonzero(langs == name)[:each] for name in languages])
    kernel = np.zeros((len(rows), len(marks)))
    for k, b in enumerate(BUCKETS):  # some landmarks and rows at a time, so that little is dense at once
        for m in range(0, len(marks), _MARKS):
            dense = Presence.of([rows[i][k] for i in marks[m : m + _MARKS]]).scattered(b)
            for at in range(0, len(rows), _ROWS):
                kernel[at : at + _ROWS, m : m + _MARKS] += Presence.of([r[k] for r in rows[at : at + _ROWS]]).times(dense)
    values, vectors = np.linalg.eigh(kernel[marks])
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T  # K^(-1/2)
    features = kernel @ root
    target = np.where(langs[:, None] == np.array(languages), 1.0, -1.0)
    share = np.array([(langs == name).sum() for name in languages])
    weight = (1 / share)[np.searchsorted(languages, langs)][:, None]  # each language counts the same
    middle, level = (features * weight).sum(0) / weight.sum(), (target * weight).sum(0) / weight.sum()
    x, y = (features - middle) * np.sqrt(weight), (target - level) * np.sqrt(weight)
    solved = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    onto = (root @ solved).astype(np.float32)
    weights = tuple(np.zeros((b, len(languages)), np.float32) for b in BUCKETS)
    for m, i in enumerate(marks):
        for k, own in enumerate(rows[i]):  # a row's buckets are distinct
            weights[k][own] += onto[m] / np.float32(np.sqrt(max(1, len(own))))
    return KernelModel(languages, weights, (level - middle @ solved).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> KernelModel:
    """Learns from at most ``per_language`` texts of each language of ``docs(doc_id, text, lang)``, and at
    most ``TEXTS`` of the ``LANGUAGES`` languages with the most rows."""
    rows = need(docs, "doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~held_out(F.col("doc_id")))
    # Thresholds on the hashed id that leave a few more than that; counted without reading a text.
    rank = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 1) / float(1 << 63)).alias("rank")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return fit_kernel([], np.zeros(0, str))
    each = max(1, min(per_language, TEXTS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], (1.5 * each + 50) / r["n"]) for r in counts], "known string, share double")
    chosen = rows.select("doc_id", "lang", "text", rank).join(F.broadcast(shares), F.col("lang") == F.col("known")).where("rank <= share")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["text"]]]
            own = [[b[:: -(-len(b) // GRAMS) or 1] for b in presence(t)] for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "rank": pdf["rank"], "sizes": [[len(b) for b in r] for r in own], "buckets": [np.concatenate(r).tobytes() for r in own]})

    made = chosen.select("lang", "text", "rank").mapInPandas(run, "lang string, rank double, sizes array<int>, buckets binary")
    # One row for each language and id, so that an id with many rows cannot outgrow the bound; then the exact bound.
    one = made.groupBy("lang", "rank").agg(F.min(F.struct("buckets", "sizes")).alias("row"))
    held = one.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "row"))), 1, each).alias("rows"))
    found = held.select("lang", F.explode("rows").alias("r")).select("lang", "r.rank", "r.row.buckets", "r.row.sizes").toPandas().sort_values(["lang", "rank"])
    cut = [np.split(np.frombuffer(b, np.int32), np.cumsum(n)[:-1]) for b, n in zip(found["buckets"], found["sizes"], strict=True)]
    return fit_kernel(cut, found["lang"].to_numpy(str))


def identify(docs: DataFrame, model: KernelModel) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row of ``docs(doc_id, text)``."""
    rows = need(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lengths x buckets x languages numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, scores = shared.value.predict(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": names, "score": scores})

    return rows.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def op5_language(spark, sf_dir: str) -> DataFrame:
    """The contract's result over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train_language(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
