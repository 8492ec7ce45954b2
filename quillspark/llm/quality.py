"""Quality classifier: a sparse rule ensemble.

Statistics of the whole text are Spark expressions. Shallow boosted trees over a bounded sample of
labelled rows give conjunctive rules (one for each path from a root), a lasso logistic regression
keeps few of them, and what it keeps is compiled back into one Spark expression. Scoring is thus a
projection without Python or shuffle.

Null and empty texts have all statistics zero and get a score like any other. Rows are kept one for
one, repeated ones too. Labels with a null doc_id or quality are not learned from; of several labels
for a doc_id the mean decides (half counts as 1), of several texts one is taken. With labels of one
value only, or none, the score is (ones + 1) / (all + 2) for every text, so without labels it is 0.5 and
nothing passes as good. An empty table gives an empty result; further columns are ignored (``keep_quality`` hands them through).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import need, written

#: Bound on the labelled rows that are learned from: those whose hashed doc_id is smallest.
SAMPLE = 6000
KEEP_FROM = 0.7
STATS = ("chars", "words", "word_length", "distinct_words", "short_words", "upper", "digits", "symbols", "line_words", "distinct_lines")


def statistics(text: Column) -> Column:
    """Struct of doubles named as in ``STATS``, over the whole text."""
    t = F.coalesce(text, F.lit(""))

    def of(words: Column, lines: Column, n: Column) -> Column:
        count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
        n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
        share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
        return F.struct(
            F.log1p(n).alias("chars"),
            F.log1p(n_words).alias("words"),
            share(n, n_words).alias("word_length"),
            share(F.size(F.array_distinct(words)).cast("double"), n_words).alias("distinct_words"),
            share(F.size(F.filter(words, lambda w: F.length(w) <= 3)).cast("double"), n_words).alias("short_words"),
            share(count(r"\p{Lu}"), n).alias("upper"),
            share(count("[0-9]"), n).alias("digits"),
            share(count(r"[^\p{L}\p{N}\s.,]"), n).alias("symbols"),
            share(n_words, n_lines).alias("line_words"),
            share(F.size(F.array_distinct(lines)).cast("double"), n_lines).alias("distinct_lines"),
        )

    bound = F.transform(F.array(F.array_remove(F.split(t, r"\s+"), "")), lambda w: of(w, F.array_remove(F.split(t, "\n"), ""), F.length(t).cast("double")))
    return bound[0]


Condition = tuple[int, bool, float]  # statistic, whether above, threshold


@dataclass(frozen=True)
class RuleModel:
    """Score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, stats: Column) -> Column:
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for stat, above, at in conditions:
                value = stats[STATS[stat]]
                holds = holds & ((value > F.lit(at)) if above else (value <= F.lit(at)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bias + sum((w * _holds(c, x) for c, w in self.rules), np.zeros(len(x))))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


def _holds(conditions: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for stat, above, at in conditions:
        out &= (x[:, stat] > at) == above
    return out


def _paths(x: np.ndarray, residual: np.ndarray, depth: int, least: int, path: tuple[Condition, ...], rows: np.ndarray) -> list[tuple[Condition, ...]]:
    """Grows one regression tree on the residual; returns the paths to its nodes."""
    if len(path) == depth or len(rows) < 2 * least:
        return []
    best = (1e-9, None)
    for stat in range(x.shape[1]):
        values = x[rows, stat]
        order = np.argsort(values, kind="stable")
        sums, n = np.cumsum(residual[rows][order]), np.arange(1, len(rows) + 1)
        gain = sums[:-1] ** 2 / n[:-1] + (sums[-1] - sums[:-1]) ** 2 / (len(rows) - n[:-1]) - sums[-1] ** 2 / len(rows)
        ordered = values[order]
        gain[(ordered[1:] <= ordered[:-1]) | (n[:-1] < least) | (len(rows) - n[:-1] < least)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (gain[at], (stat, float((ordered[at] + ordered[at + 1]) / 2)))
    if best[1] is None:
        return []
    stat, at = best[1]
    above = x[rows, stat] > at
    out = []
    for side in (True, False):
        longer = (*path, (stat, side, at))
        out += [longer, *_paths(x, residual, depth, least, longer, rows[above == side])]
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 0.002, rounds: int = 1500) -> RuleModel:
    """Learns from statistics ``x`` and labels ``y`` (0 or 1); the same input gives the same model."""
    ones = int(y.sum())
    if not 0 < ones < len(y):
        share = (ones + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    random = np.random.default_rng(0)
    logit, rules = np.full(len(y), np.log(ones / (len(y) - ones))), {}
    for _ in range(trees):
        part = random.choice(len(y), max(2, len(y) // 2), replace=False)
        residual = y - _sigmoid(logit)
        paths = _paths(x[part], residual[part], depth, max(3, len(y) // 200), (), np.arange(len(part)))
        rules |= dict.fromkeys(paths)
        step = np.full(len(y), residual[part].mean())
        for p in sorted(paths, key=len):  # a deeper node's mean replaces that of the one above
            step[_holds(p, x)] = residual[part][_holds(p, x[part])].mean()
        logit = logit + 2 * step
    names = list(rules)
    if not names:  # too few rows to split
        return RuleModel(float(np.log(ones / (len(y) - ones))), ())
    hold = np.array([_holds(c, x) for c in names], float).T
    scale = np.maximum(hold.std(axis=0), 1e-3)
    z = (hold - hold.mean(axis=0)) / scale
    # Accelerated proximal gradient descent on the lasso logistic loss.
    weight = ahead = np.zeros(len(names))
    bias = np.log(ones / (len(y) - ones))
    pace, t = 4 * len(y) / (np.linalg.norm(z, 2) ** 2 + 1e-9), 1.0
    for _ in range(rounds):
        off = _sigmoid(bias + z @ ahead) - y
        bias -= 2 * off.mean()
        moved = ahead - pace * (z.T @ off) / len(y)
        moved = np.sign(moved) * np.maximum(np.abs(moved) - pace * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, weight = moved + (before - 1) / t * (moved - weight), moved
    used = np.flatnonzero(weight)
    raw = weight[used] / scale[used]
    return RuleModel(float(bias - raw @ hold[:, used].mean(axis=0)), tuple((names[k], float(w)) for k, w in zip(used, raw, strict=True)))


def train_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> RuleModel:
    """Model from the rows of ``labels(doc_id, quality)`` that may be learned from; at most ``most``."""
    given = need(labels, "doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL")
    given = given.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    kept = written(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")  # so it has ``most`` rows or fewer
    own = kept.select(F.col("doc_id").alias("known"), "y")
    texts = need(docs, "doc_id", "text")
    rows = texts.join(F.broadcast(own), texts["doc_id"] == own["known"])
    rows = rows.groupBy("known").agg(F.min(F.struct(statistics(F.col("text")).alias("s"), "y")).alias("row"))
    found = rows.select("known", *[F.col(f"row.s.{s}") for s in STATS], "row.y").toPandas().sort_values("known")
    return fit_rules(found[list(STATS)].to_numpy(float), found["y"].to_numpy(float))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``(row, score)``: each row of ``docs`` as a struct, with its score."""
    # The generator keeps the optimizer from computing the statistics once for each rule.
    stats = docs.select(F.struct("*").alias("row"), F.explode(F.array(statistics(F.col("text")))).alias("stats"))
    return stats.select("row", model.column(F.col("stats")).alias("score"))


def keep_quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Rows of ``docs``, all columns, with a score of at least ``keep_from``."""
    return scored(docs, train_quality(docs, labels)).where(F.col("score") >= keep_from).select("row.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's result over the whole ``documents`` table."""
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
