"""Language-model scoring by masked pseudo-likelihood.

A small network predicts every token of a text from the ``REACH`` tokens on both its sides: a learned
vector for each place and neighbour, summed and squashed to a hidden layer, then a softmax over token
clusters and one over the tokens of the cluster. A document's score is the sum of its words'
conditional log-probabilities.

The network's tokens follow from the counts of all words of all documents; rarer words share buckets by
their ends. Within its bucket, a word has the probability of its count in the whole corpus, smoothed for
unseen words; these counts are a table that grows with the corpus. Those of a bounded number of words are
broadcast, those of all others joined, never collected.

The network is trained in numpy over all documents, each of which is passed once. Documents are dealt by a
hash of id and text into groups of about ``GROUP`` words and ordered by it, so the result follows from
the documents alone and not from how the input is split into tasks. The groups are
trained in ``ROUNDS``: in a round each task trains groups from the same start, the results are averaged by
the number of tokens (in a fixed order, a few at a time, on the executors), and the next round goes on
from there with the next groups. One model reaches the driver. The network's size depends on the
parameters, not on the input.

Null and empty texts have no token, sum 0 and a null mean. Rows are kept one for one, repeated ones
too (rows with the same id and text are in one group, which is streamed); texts of any length are read
whole. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import need, written

REACH, HIDDEN, CLUSTERS, EACH = 2, 16, 32, 64
#: Words with a token of their own, and buckets for the others; words of which the counts are broadcast.
FREQUENT, RARE, KNOWN = 1792, 256, 65_536
#: Words of a group, rounds of training, and models that are averaged at once.
GROUP, ROUNDS, FAN = 1 << 20, 2, 16
EDGE = FREQUENT + RARE  # stands beyond both ends of a text
PLACES = tuple(o for o in range(-REACH, REACH + 1) if o)
_BATCH, _CHUNK, _MEMO, PACE = 8192, 1 << 15, 500_000, 0.08
#: Tokens that are learned from at once, and words that a task counts before it sends them on.
_HELD, _COUNTED = 1 << 17, 300_000
#: Added to the count of each word of a bucket, and given to all unseen words of it together.
UNSEEN = 0.5

Weights = dict[str, np.ndarray]


def _bucket(word: str) -> int:
    return zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % RARE


def _key(word: str, bucket: int) -> int:
    """Hash of a rarer word, as a signed long, that ends in its bucket."""
    key = (xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42) & ~(RARE - 1)) | bucket
    return key - (1 << 64) if key >> 63 else key


class Words(dict):
    """Number of each word, by which its token, its share of its bucket and its key are found.

    The share is the log-probability within the bucket: 0 for words with a token of their own, not a
    number for words that ``shares`` lacks, which have a key instead. What is looked up is remembered up to a bound.
    """

    def __init__(self, frequent: list[str], shares: dict[str, float] | None = None) -> None:
        super().__init__()
        self.frequent, self.given = frequent[:FREQUENT], shares or {}
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self._tokens, self._shares, self._keys = list(range(len(self.frequent))), [0.0] * len(self.frequent), [0] * len(self.frequent)
        self.update((w, k) for k, w in enumerate(self.frequent))
        self.token, self.share, self.key = np.array(self._tokens, np.uint16), np.array(self._shares), np.array(self._keys, np.int64)

    def __missing__(self, word: str) -> int:
        bucket, share = _bucket(word), self.given.get(word, np.nan)
        self[word] = k = len(self._tokens)
        self._tokens.append(FREQUENT + bucket)
        self._shares.append(share)
        self._keys.append(0 if share == share else _key(word, bucket))
        return k

    def __reduce__(self):
        return Words, (self.frequent, self.given)

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, to be used before the next call, and how many each text has."""
        if len(self) > _MEMO:
            self._begin()
        out, counts, look = [], np.zeros(len(texts), np.int64), self.__getitem__
        for k, text in enumerate(texts):
            words = (text or "").lower().split()
            out.extend(map(look, words))
            counts[k] = len(words)
        new = len(self.token)
        if len(self._tokens) > new:
            self.token = np.append(self.token, np.array(self._tokens[new:], np.uint16))
            self.share, self.key = np.append(self.share, self._shares[new:]), np.append(self.key, np.array(self._keys[new:], np.int64))
        return np.array(out, np.int64), counts

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts with ``REACH`` edges before, between and after; number of each text."""
        numbers, counts = self.numbers(texts)
        return edged(self.token[numbers], counts), counts


def edged(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts' tokens, one text after another, with edges before, between and after."""
    out = np.full(len(tokens) + REACH * (len(counts) + 1), EDGE, np.uint16)
    out[np.arange(len(tokens)) + REACH * (1 + np.repeat(np.arange(len(counts)), counts))] = tokens
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all rows of ``docs(text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                found.update((text or "").lower().split())
                if len(found) > _COUNTED:
                    yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                    found = Counter()
        yield pd.DataFrame({"word": list(found), "n": list(found.values())}).astype({"word": object, "n": "int64"})

    return need(docs, "text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket_sizes(counts: DataFrame, frequent: list[str]) -> np.ndarray:
    """Smoothed count of all words of each bucket. ``counts(word, n)`` is of the whole corpus."""
    seen = counts.where(~F.col("word").isin(frequent)).select(_bucket_of(F.col("word")).alias("bucket"), "n")
    sizes = np.full(RARE, UNSEEN)
    for r in seen.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        sizes[r["bucket"]] += r["n"] + UNSEEN * r["words"]
    return sizes


def _bucket_of(word: Column) -> Column:
    return (F.crc32(F.encode(F.substring(word, -3, 3), "UTF-8")) % RARE).cast("int")


def top_words(counts: DataFrame) -> list[tuple[str, int]]:
    """About the ``KNOWN`` most frequent words with their counts, most frequent first; the first ``FREQUENT``
    are exactly the most frequent ones, ties by word.

    A sketch of the counts gives the bound from which words are collected, so that no more reaches the
    driver, however many partitions there are.
    """
    words = counts.count()
    found = counts
    if words > KNOWN:
        at = counts.agg(F.percentile_approx("n", 1 - KNOWN / words, 200_000).alias("at")).first()["at"]
        found = counts.where(F.col("n") > at)
        if found.limit(FREQUENT).count() < FREQUENT:  # too many share the bound
            found = counts.orderBy(F.desc("n"), "word").limit(FREQUENT)
    return sorted(((r["word"], r["n"]) for r in found.select("word", "n").collect()), key=lambda w: (-w[1], w[0]))


def rest_shares(rest: DataFrame, counts: DataFrame, sizes: np.ndarray) -> DataFrame:
    """``(key, within)`` of the texts of ``rest(text_key, rest)`` with words of which the counts are not
    broadcast: the mean of their log-probabilities within their buckets."""
    keyed = F.xxhash64("word").bitwiseAND(F.lit(-RARE)).bitwiseOR(_bucket_of(F.col("word")).cast("long"))
    table = counts.select(keyed.alias("seen"), F.log(F.col("n") + UNSEEN).alias("log_n"))
    said = rest.select("text_key", F.explode("rest").alias("word_key"))
    met = said.join(table, said["word_key"] == table["seen"], "left")
    log_size = F.get(F.array(*[F.lit(float(x)) for x in np.log(sizes)]), F.col("word_key").bitwiseAND(F.lit(RARE - 1)).cast("int"))
    log_p = F.coalesce("log_n", F.lit(float(np.log(UNSEEN)))) - log_size
    return met.groupBy(F.col("text_key").alias("key")).agg(F.avg(log_p).alias("within"))


def start(seed: int = 0) -> Weights:
    random = np.random.default_rng(seed)
    return {
        "near": random.normal(0, 0.1, (len(PLACES), EDGE + 1, HIDDEN)).astype(np.float32),
        "cluster": random.normal(0, 0.1, (HIDDEN, CLUSTERS)).astype(np.float32),
        "cluster_bias": np.zeros(CLUSTERS, np.float32),
        "inner": random.normal(0, 0.1, (CLUSTERS, HIDDEN, EACH)).astype(np.float32),
        "inner_bias": np.zeros((CLUSTERS, EACH), np.float32),
    }


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column (sums down the columns run along memory)."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _log_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each column at one place."""
    x -= x.max(axis=0)
    own = x[at, np.arange(x.shape[1])]
    return own - np.log(np.exp(x, out=x).sum(axis=0))


def _logits(weights: np.ndarray, bias: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    out = weights.T @ hidden.T
    out += bias[:, None]
    return out


def _hidden(w: Weights, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = w["near"][0][tokens[at + PLACES[0]]]
    for k, o in enumerate(PLACES[1:], 1):
        total += w["near"][k][tokens[at + o]]
    return np.tanh(total)


def log_probabilities(w: Weights, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the token at each place, given its neighbours on both sides."""
    out = np.empty(len(at))
    for lo in range(0, len(at), _CHUNK):
        part = at[lo : lo + _CHUNK]
        order = np.argsort(tokens[part], kind="stable")  # the tokens of a cluster stand together
        part = part[order]
        hidden, target = _hidden(w, tokens, part), tokens[part].astype(np.int64)
        of, inner = np.divmod(target, EACH)
        log_p = _log_at(_logits(w["cluster"], w["cluster_bias"], hidden), of)
        bounds = np.searchsorted(of, np.arange(CLUSTERS + 1))
        for c in range(CLUSTERS):
            a, b = bounds[c], bounds[c + 1]
            if a < b:
                log_p[a:b] += _log_at(_logits(w["inner"][c], w["inner_bias"][c], hidden[a:b]), inner[a:b])
        out[lo + order] = log_p
    return out


class Trainer:
    """Adaptive gradient steps from given weights, and from the squared gradients seen so far."""

    def __init__(self, weights: Weights, seen: Weights | None = None) -> None:
        self.w = {k: v.copy() for k, v in weights.items()}
        self.seen = {k: v.copy() for k, v in seen.items()} if seen else {k: np.full_like(v, 1e-6) for k, v in weights.items()}

    def _step(self, name: str, where, gradient: np.ndarray) -> None:
        self.seen[name][where] += gradient * gradient
        self.w[name][where] -= PACE * gradient / np.sqrt(self.seen[name][where])

    def batch(self, tokens: np.ndarray, at: np.ndarray) -> None:
        at = at[np.argsort(tokens[at], kind="stable")]
        n, w = len(at), self.w
        hidden, target = _hidden(w, tokens, at), tokens[at].astype(np.int64)
        of, inner = np.divmod(target, EACH)
        off = _softmax(_logits(w["cluster"], w["cluster_bias"], hidden))
        off[of, np.arange(n)] -= 1
        back = off.T @ w["cluster"].T
        gradient, bounds = hidden.T @ off.T, np.searchsorted(of, np.arange(CLUSTERS + 1))
        for c in range(CLUSTERS):
            a, b = bounds[c], bounds[c + 1]
            if a < b:
                own = _softmax(_logits(w["inner"][c], w["inner_bias"][c], hidden[a:b]))
                own[inner[a:b], np.arange(b - a)] -= 1
                back[a:b] += own.T @ w["inner"][c].T
                self._step("inner", c, hidden[a:b].T @ own.T / n)
                self._step("inner_bias", c, own.sum(axis=1) / n)
        self._step("cluster", slice(None), gradient / n)
        self._step("cluster_bias", slice(None), off.sum(axis=1) / n)
        back *= (1 - hidden * hidden) / n
        for k, o in enumerate(PLACES):
            ids = tokens[at + o]
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            self._step("near", (k, ids[first].astype(np.int64)), np.add.reduceat(back[order], first, axis=0))

    def learn(self, tokens: np.ndarray) -> int:
        at = np.flatnonzero(tokens != EDGE)
        for lo in range(0, len(at), _BATCH):
            self.batch(tokens, at[lo : lo + _BATCH])
        return len(at)


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def _shaped(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, v in start().items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _averaged(models: DataFrame, n: int) -> DataFrame:
    """The mean of the models ``(at, model, n)`` with ``at`` from 0 to n - 1, weighed by their tokens: some
    that follow one another are averaged at once, in their order, until one is left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total, n = None, None, 0
        for pdf in batches:
            for k, raw, own in zip((pdf["at"] // FAN).tolist(), pdf["model"], pdf["n"].tolist(), strict=True):
                if k != at and n:
                    yield pd.DataFrame({"at": [at], "model": [(total / n).astype(np.float32).tobytes()], "n": [n]})
                    total, n = None, 0
                part = np.frombuffer(raw, np.float32).astype(float) * own
                at, total, n = k, part if total is None else total + part, n + own
        if n:
            yield pd.DataFrame({"at": [at], "model": [(total / n).astype(np.float32).tobytes()], "n": [n]})

    while n > 1:
        n = -(-n // FAN)
        parts = min(n, MOST_TASKS)
        models = models.repartitionById(parts, (F.floor(F.col("at") / FAN) % parts).cast("int")).sortWithinPartitions("at")
        models = written(models.mapInPandas(run, "at long, model binary, n long"), "models")
    return models


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at least ``most`` together."""
    lo, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        size += n
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


#: Tasks of a round at most; beyond, a task trains several groups one after another.
MOST_TASKS = 100_000


@dataclass(frozen=True)
class Corpus:
    """What is known of all words: those with a token of their own, the number of running words, and, if
    words are to be predicted within their buckets, all counts, the smoothed sizes of the buckets, and the
    log-probability within its bucket of each of the most frequent words."""

    frequent: list[str]
    words: int
    counts: DataFrame | None = None
    sizes: np.ndarray | None = None
    shares: dict[str, float] | None = None


def corpus_of(counts: DataFrame, frequent: list[str] | None = None, within: bool = True) -> Corpus:
    counts = counts.select("word", "n")
    top = top_words(counts)
    frequent = [w for w, _ in top[:FREQUENT]] if frequent is None else frequent
    words = counts.agg(F.sum("n")).first()[0] or 0
    if not within:
        return Corpus(frequent, words)
    sizes = bucket_sizes(counts, frequent)
    return Corpus(frequent, words, counts, sizes, {w: float(np.log((n + UNSEEN) / sizes[_bucket(w)])) for w, n in top})


def encoded(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """``(doc_id, text_key, key, n_tokens, within, rest, tokens)`` a row of ``docs``: the only pass that cuts texts.

    ``within`` is the sum of the shares that are broadcast, ``rest`` has the keys of the words whose count is not.
    """
    rows = need(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Words(corpus.frequent, corpus.shares))
    asked = corpus.shares is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _pieces(np.array([len(t or "") for t in texts]), 4_000_000):
                numbers, n = words.numbers(texts[lo:hi])
                share, of = words.share[numbers], np.repeat(np.arange(hi - lo), n)
                none = np.isnan(share) if asked else np.zeros(len(share), bool)
                within = np.bincount(of[~none], share[~none], minlength=hi - lo).astype(float) if asked else np.zeros(hi - lo)
                ends = np.concatenate(([0], np.cumsum(np.bincount(of[none], minlength=hi - lo))))
                raw = np.concatenate(([0], np.cumsum(2 * n)))
                parts = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_key", "key")]
                parts += [pa.array(n), pa.array(within), pa.LargeListArray.from_arrays(pa.array(ends), pa.array(words.key[numbers[none]])).cast(pa.list_(pa.int64()))]
                tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(raw.astype(np.int64)), pa.py_buffer(words.token[numbers])])
                yield pa.RecordBatch.from_arrays([*parts, tokens.cast(pa.binary())], names=["doc_id", "text_key", "key", "n_tokens", "within", "rest", "tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, key long, n_tokens long, within double, rest array<long>, tokens binary")


def _finished(trainer: Trainer, at: int, n: int, held: list[np.ndarray]) -> pd.DataFrame:
    """A group's model, after what is still held has been learned."""
    n += _learned(trainer, held)
    return pd.DataFrame({"at": [at], "model": [np.concatenate((_flat(trainer.w), _flat(trainer.seen))).tobytes()], "n": [n]})


def _learned(trainer: Trainer, held: list[np.ndarray]) -> int:
    return trainer.learn(edged(np.concatenate(held), np.array([len(x) for x in held]))) if held else 0


def train_on(made: DataFrame, words: int) -> Weights:
    """Network from all rows of ``made(key, n_tokens, tokens)``, in which there are ``words`` words."""
    spark, groups = made.sparkSession, -(-words // GROUP)
    dealt = made.where("n_tokens > 0").select("key", "tokens", F.pmod(F.col("key"), F.lit(max(1, groups))).alias("grp"))
    weights, seen = start(), None
    for r in range(ROUNDS):
        lo, hi = groups * r // ROUNDS, groups * (r + 1) // ROUNDS
        if lo == hi:
            continue
        begin = spark.sparkContext.broadcast((weights, seen))

        def learn(batches: Iterator[pd.DataFrame], begin=begin, lo=lo) -> Iterator[pd.DataFrame]:
            trainer, at, n, held, size = None, None, 0, [], 0
            for pdf in batches:
                for grp, raw in zip(pdf["grp"].tolist(), pdf["tokens"], strict=True):
                    if grp != at:
                        if trainer is not None:
                            yield _finished(trainer, at - lo, n, held)
                        trainer, at, n, held, size = Trainer(*begin.value), grp, 0, [], 0
                    held.append(np.frombuffer(raw, np.uint16))
                    size += len(held[-1])
                    if size >= _HELD:
                        n += _learned(trainer, held)
                        held, size = [], 0
            if trainer is not None:
                yield _finished(trainer, at - lo, n, held)

        parts = min(hi - lo, MOST_TASKS)
        own = dealt.where((F.col("grp") >= lo) & (F.col("grp") < hi))
        own = own.repartitionById(parts, ((F.col("grp") - lo) % parts).cast("int")).sortWithinPartitions("grp", "key")
        models = written(own.mapInPandas(learn, "at long, model binary, n long"), "models")
        last = _averaged(models, hi - lo).collect()
        if last:
            flat = np.frombuffer(last[0]["model"], np.float32)
            weights, seen = _shaped(flat[: len(flat) // 2]), _shaped(flat[len(flat) // 2 :])
    return weights


def score_on(made: DataFrame, weights: Weights, corpus: Corpus) -> DataFrame:
    """``(doc_id, n_tokens, sum_logprob, mean_logprob)`` a row of ``made``, as ``encoded`` gives it."""
    shared, kind = made.sparkSession.sparkContext.broadcast(weights), made.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, raw = batch.column("n_tokens").to_numpy(), batch.column("tokens").to_pylist()
            sums = np.zeros(len(n))
            for lo, hi in _pieces(n, 1 << 20):
                tokens = edged(np.frombuffer(b"".join(raw[lo:hi]), np.uint16), n[lo:hi])
                log_p = log_probabilities(shared.value, tokens, np.flatnonzero(tokens != EDGE))
                sums[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n[lo:hi]), log_p, minlength=hi - lo)
            total = sums + batch.column("within").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("n_tokens"), pa.array(total), batch.column("n_rest")], names=["doc_id", "text_key", "n_tokens", "sum_logprob", "n_rest"])

    given = made.select("doc_id", "text_key", "n_tokens", "tokens", "within", F.size("rest").alias("n_rest"))
    out = given.mapInArrow(run, f"doc_id {kind}, text_key long, n_tokens long, sum_logprob double, n_rest int")
    if corpus.counts is not None:
        within = rest_shares(made.select("text_key", "rest"), corpus.counts, corpus.sizes)
        out = out.join(within, out["text_key"] == within["key"], "left")
        out = out.withColumn("sum_logprob", F.col("sum_logprob") + F.col("n_rest") * F.coalesce("within", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "sum_logprob", F.try_divide("sum_logprob", "n_tokens").alias("mean_logprob"))


def train(docs: DataFrame, counts: DataFrame | None = None) -> tuple[list[str], Weights]:
    """Vocabulary and network from all rows of ``docs(doc_id, text)``; ``counts`` if its words are counted already."""
    corpus = corpus_of(count_words(docs) if counts is None else counts, within=False)
    return corpus.frequent, train_on(written(encoded(docs, corpus), "tokens"), corpus.words)


def score(docs: DataFrame, frequent: list[str], weights: Weights, counts: DataFrame | None = None) -> DataFrame:
    """``(doc_id, n_tokens, sum_logprob, mean_logprob)`` a row of any ``docs(doc_id, text)``: of the words, if
    their ``counts(word, n)`` in the corpus are given, otherwise of the network's tokens alone."""
    corpus = Corpus(frequent, 0) if counts is None else corpus_of(counts, frequent)
    return score_on(written(encoded(docs, corpus), "tokens"), weights, corpus)


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents`` under a model trained on all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus = corpus_of(written(count_words(docs), "counts"))
    made = written(encoded(docs, corpus), "tokens")
    return score_on(made, train_on(made, corpus.words), corpus)
