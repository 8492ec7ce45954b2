"""Language identification, quality and pseudo-likelihood: held-out accuracy and plain versions."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from odd import ODD_TEXTS, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from quillspark.llm import language, pseudo, quality

SF = "/root/testdata/sf0.1"
FIT = language.fit_kernel


# --- language ---


def plain_ngrams(text, n):
    text = text.lower()
    return {text[k : k + n] for k in range(len(text) - n + 1)}


def test_presence_counts_ngrams():
    text = "Straße ñandú, the 中国 x" * 3
    for k, n in enumerate(language.LENGTHS):
        grams, marked = plain_ngrams(text, n), language.presence(text)[k]
        assert 0.97 * len(grams) <= len(marked) <= len(grams)  # less only where buckets collide
        assert (np.diff(marked) > 0).all() and marked.max() < language.BUCKETS[k]
    assert not any(len(b) for b in language.presence(""))
    long = " ".join(prose(40, seed=3, size=(400, 500), vocabulary=3000))
    assert all(np.array_equal(a, b) for a, b in zip(language.presence(long), language.presence(long + " " + long)[:1]))


def test_scores_equal_the_kernel_form():
    """The multiplied-out matrices against kernel values, Nystroem map and ridge, step by step."""
    texts = prose(30, seed=1) + [t.upper() + " zzz qqq" for t in prose(30, seed=2, vocabulary=50)]
    langs = np.array(["a"] * 30 + ["b"] * 30)
    rows = [language.presence(t) for t in texts]
    model = language.fit_kernel(rows, langs, landmarks=8)
    marks = [*range(8), *range(30, 38)]
    kernel = lambda x, y: sum(len(np.intersect1d(p, q)) / np.sqrt(max(len(p), 1) * max(len(q), 1)) for p, q in zip(x, y))
    k_mm = np.array([[kernel(rows[i], rows[j]) for j in marks] for i in marks])
    k_nm = np.array([[kernel(b, rows[j]) for j in marks] for b in rows])
    values, vectors = np.linalg.eigh(k_mm)
    f = k_nm @ (vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T)
    y = np.where(langs[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    f0, y0 = f - f.mean(0), y - y.mean(0)
    w = np.linalg.solve(f0.T @ f0 / 30 + language.RIDGE * np.eye(16), f0.T @ y0 / 30)
    assert np.allclose(model.margins(rows), y.mean(0) + f0 @ w, atol=2e-3)
    assert np.allclose(model.margins([*rows[:2], language.presence("")])[:2], model.margins(rows)[:2], atol=1e-5)


def test_long_texts_keep_their_language(spark):
    """Whole texts of a million characters, joined of held-out ones of a language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, table = language.train_language(docs), pd.read_parquet(f"{SF}/documents.parquet")
    table = table[[zlib.crc32(str(i).encode()) % 5 == 0 for i in table.doc_id]]
    for lang, own in table.groupby("lang"):
        whole = " ".join(own.text)
        whole = (whole * (1_000_000 // len(whole) + 1))[:1_000_000]
        names, scores = model.predict([whole, whole[:20_000]])
        assert names == [lang, lang] and scores.min() > 0.7, (lang, scores)


def test_many_languages_are_bounded(spark, monkeypatch):
    """Dirty labels: the languages with the most texts are learned, from a bounded number of texts."""
    monkeypatch.setattr(language, "LANGUAGES", 6)
    monkeypatch.setattr(language, "TEXTS", 30)
    monkeypatch.setattr(language, "LANDMARKS", 12)
    seen = []
    monkeypatch.setattr(language, "fit_kernel", lambda rows, langs: seen.append((rows, langs)) or FIT(rows, langs))
    texts = prose(400, seed=4)
    rows = [(k, t, f"l{k % 4}" if k < 300 else f"dirt{k}") for k, t in enumerate(texts)]
    model = language.train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 6 and set(model.languages) > {"l0", "l1", "l2", "l3"} and len(seen[0][0]) <= 30


def test_language_accuracy_on_held_out_rows(spark):
    found = language.op5_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert len(found) == 10_000 and (held.lang_pred == held.lang).mean() > 0.99 and found.score.between(0, 1).all()


def test_language_odd_rows(spark):
    docs = odd_docs(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 3 == 0, "fr"))
    found = language.identify(docs, language.train_language(docs))
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < len(ODD_TEXTS):
            text = ODD_TEXTS[r["doc_id"]]
            assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or "")) and (r["score"] == 0) == (r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in rows} <= {"en", "fr", "und"}
    assert language.identify(no_docs(spark), language.train_language(docs)).collect() == []
    assert {r["lang_pred"] for r in language.identify(docs, language.train_language(no_docs(spark))).collect()} == {"und"}


# --- quality ---


def test_statistics_equal_plain_ones(spark):
    docs = odd_docs(spark)
    rows = docs.select("text", quality.statistics(F.col("text")).alias("s")).select("text", "s.*").collect()
    for r in rows:
        t = r["text"] or ""
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
        lines = [x for x in t.split("\n") if x]
        share = lambda a, b: a / b if b else 0.0
        want = (np.log1p(len(t)), np.log1p(len(words)), share(len(t), len(words)), share(len(set(words)), len(words)), share(sum(len(w) <= 3 for w in words), len(words)), share(len([c for c in t if c.isupper()]), len(t)), share(len(re.findall("[0-9]", t)), len(t)))
        assert np.allclose([r[s] for s in quality.STATS[:7]], want), t[:40]
        assert r["line_words"] == pytest.approx(share(len(words), len(lines))) and r["distinct_lines"] == pytest.approx(share(len(set(lines)), len(lines)))


def test_column_equals_the_rules(spark):
    random = np.random.default_rng(3)
    x = random.random((600, len(quality.STATS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] < 0.7) | (random.random(600) < 0.05)).astype(float)
    model = quality.fit_rules(x, y)
    assert 0 < len(model.rules) < 200 and ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.93
    table = spark.createDataFrame(pd.DataFrame(x, columns=list(quality.STATS)))
    scores = table.select(model.column(F.struct(*quality.STATS)).alias("s")).toPandas()["s"]
    assert np.allclose(scores, model.score(x))
    assert quality.fit_rules(x, y) == model


def test_labels_of_one_kind():
    x = np.zeros((3, len(quality.STATS)))
    assert quality.fit_rules(x, np.ones(3)).score(x)[0] == pytest.approx(0.8)
    assert quality.fit_rules(x, np.zeros(3)).score(x)[0] == pytest.approx(0.2)
    assert quality.fit_rules(x[:0], np.ones(0)).score(x)[0] == pytest.approx(0.5)


def test_quality_on_held_out_rows(spark):
    found = quality.op6_quality(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet").merge(found, on="doc_id")
    held = labels[labels.held_out]
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert len(found) == 10_000 and (held.predicted == held.quality).mean() > 0.98 and ((found.score >= 0.7) == (found.predicted == 1)).all()


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(0, 0), (1, None), (None, 1), (3, 1), (4, 1), (4, 0), (5, 0), (90, 1), (7, 3), (8, 0)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    rows = quality.scored(docs, model).select("row.doc_id", "score").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep_quality(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.keep_quality(docs, labels.where("1 = 0"), 0.5).count() == docs.count()
    assert quality.keep_quality(docs, labels.where("1 = 0")).count() == 0  # without evidence nothing passes
    assert quality.keep_quality(no_docs(spark), labels).count() == 0


# --- pseudo-likelihood ---


def plain_log_probability(w, tokens, at):
    hidden = np.tanh(sum(w["near"][k][tokens[at + o]] for k, o in enumerate(pseudo.PLACES)))
    of, inner = divmod(int(tokens[at]), pseudo.EACH)
    a = hidden @ w["cluster"] + w["cluster_bias"]
    b = hidden @ w["inner"][of] + w["inner_bias"][of]
    return a[of] - np.log(np.exp(a).sum()) + b[inner] - np.log(np.exp(b).sum())


@pytest.fixture(scope="module")
def trained():
    texts = prose(300, seed=7, vocabulary=60)
    ordered = [" ".join(sorted(t.split())) for t in texts]  # neighbours tell much
    vocabulary = pseudo.Words(sorted({w for t in ordered for w in t.split()}))
    trainer = pseudo.Trainer(pseudo.start())
    for _ in range(3):
        trainer.learn(vocabulary.tokens(ordered[:250])[0])
    return vocabulary, trainer.w, ordered


def test_log_probabilities_equal_plain_ones(trained):
    vocabulary, w, texts = trained
    tokens, _ = vocabulary.tokens([texts[0], "", None, texts[1]])
    at = np.flatnonzero(tokens != pseudo.EDGE)
    assert np.allclose(pseudo.log_probabilities(w, tokens, at), [plain_log_probability(w, tokens, k) for k in at], atol=1e-4)


def test_probabilities_of_all_tokens_sum_to_one(trained):
    _, w, _ = trained
    tokens = np.array([pseudo.EDGE, pseudo.EDGE, 3, 0, 5, pseudo.EDGE, pseudo.EDGE], np.uint16)
    total = 0.0
    for token in range(pseudo.EDGE):
        tokens[3] = token
        total += np.exp(plain_log_probability(w, tokens, 3))
    assert total == pytest.approx(1, abs=1e-3)


def test_gradient_steps_follow_the_loss():
    """One step from the start lowers the loss of its own batch, in every group of weights."""
    vocabulary = pseudo.Words([f"w{k}" for k in range(40)])
    tokens, _ = vocabulary.tokens([" ".join(f"w{k % 40}" for k in range(2000))])
    at = np.flatnonzero(tokens != pseudo.EDGE)
    before = pseudo.log_probabilities(pseudo.start(), tokens, at).mean()
    trainer = pseudo.Trainer(pseudo.start())
    trainer.batch(tokens, at)
    for name in trainer.w:
        w = pseudo.start() | {name: trainer.w[name]}
        assert pseudo.log_probabilities(w, tokens, at).mean() > before, name


def test_order_is_learned(trained):
    vocabulary, w, texts = trained
    held = texts[250:]
    score = lambda ts: pseudo.log_probabilities(w, t := vocabulary.tokens(ts)[0], np.flatnonzero(t != pseudo.EDGE)).mean()
    rnd = np.random.default_rng(0)
    shuffled = [" ".join(rnd.permutation(t.split())) for t in held]
    assert score(held) > score(shuffled) + 1


def test_scores_of_rows(spark):
    docs = odd_docs(spark, [*ODD_TEXTS, *prose(20)])
    frequent, w = pseudo.train(docs)
    rows = pseudo.score(docs, frequent, w).collect()
    assert len(rows) == docs.count()
    vocabulary = pseudo.Words(frequent)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id IS NOT NULL").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            tokens, counts = vocabulary.tokens([texts[r["doc_id"]]])
            assert r["n_tokens"] == counts[0]
            assert r["sum_logprob"] == pytest.approx(pseudo.log_probabilities(w, tokens, np.flatnonzero(tokens != pseudo.EDGE)).sum(), rel=1e-4)
            assert (r["mean_logprob"] is None) == (counts[0] == 0)
    assert pseudo.score(no_docs(spark), *pseudo.train(no_docs(spark))).collect() == []


def test_vocabulary_counts_all_words(spark):
    docs = spark.createDataFrame([(1, "a B a"), (2, "b\na"), (3, None), (4, "")], "doc_id long, text string")
    assert {tuple(r) for r in pseudo.count_words(docs).collect()} == {("a", 3), ("b", 2)}


@pytest.mark.parametrize("known", [65_536, 1000, 0])
def test_every_word_is_predicted(spark, known, monkeypatch):
    """The network's tokens, and each rarer word within its bucket by its count in the corpus, whether
    that count is broadcast or joined."""
    monkeypatch.setattr(pseudo, "KNOWN", max(known, pseudo.FREQUENT if known else 0))
    monkeypatch.setattr(pseudo, "FREQUENT", 100)
    texts = [*ODD_TEXTS, *prose(20), "aaing bbing\x85bbing", "aaing bbing\x85bbing"]
    docs = odd_docs(spark, texts)
    counts = pseudo.count_words(docs)
    frequent, w = pseudo.train(docs, counts)
    vocabulary, n = pseudo.Words(frequent), {}
    for r in docs.collect():
        for word in (r["text"] or "").lower().split():
            n[word] = n.get(word, 0) + 1
    assert {r["word"]: r["n"] for r in counts.collect()} == n
    token = {x: int(vocabulary.tokens([x])[0][pseudo.REACH]) for x in n}
    rare = {x: t for x, t in token.items() if t >= pseudo.FREQUENT}
    size = {t: sum(n[x] + pseudo.UNSEEN for x in rare if rare[x] == t) + pseudo.UNSEEN for t in set(rare.values())}
    alone = {r["doc_id"]: r["sum_logprob"] for r in pseudo.score(docs, frequent, w).collect()}
    rows = pseudo.score(docs, frequent, w, counts).collect()
    assert len(rows) == docs.count() and rare
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 90:
            words = [x for x in (texts[r["doc_id"]] or "").lower().split() if x in rare]
            want = alone[r["doc_id"]] + sum(np.log((n[x] + pseudo.UNSEEN) / size[rare[x]]) for x in words)
            assert r["sum_logprob"] == pytest.approx(want, rel=1e-6)
    new = spark.createDataFrame([(1, "zzzzing")], "doc_id long, text string")
    extra = pseudo.score(new, frequent, w, counts).first()["sum_logprob"] - pseudo.score(new, frequent, w).first()["sum_logprob"]
    assert extra == pytest.approx(np.log(pseudo.UNSEEN / size.get(pseudo.FREQUENT + pseudo._bucket("zzzzing"), pseudo.UNSEEN)), abs=1e-6)


def test_what_is_looked_up_is_bounded(monkeypatch):
    words, texts = pseudo.Words(["a", "b"], {"cc": -1.5}), ["a cc x1 b", "", None, "x2 x1 cc"]
    numbers, n = words.numbers(texts)
    assert n.tolist() == [4, 0, 0, 3] and words.token[numbers][[0, 3]].tolist() == [0, 1]
    shares, keys = words.share[numbers], words.key[numbers]
    assert shares[[0, 3, 1, 6]].tolist() == [0, 0, -1.5, -1.5] and np.isnan(shares[[2, 4, 5]]).all()
    assert keys[2] == keys[5] == pseudo._key("x1", pseudo._bucket("x1")) and not keys[[0, 1, 3, 6]].any()
    monkeypatch.setattr(pseudo, "_MEMO", 3)
    for k in range(5):
        again, _ = words.numbers(["a cc x1 b", f"y{k} x2 x1 cc"])
        assert words.key[again][[2, 6]].tolist() == [keys[2]] * 2 and len(words) <= 8
    assert pseudo.edged(np.array([5, 6, 7], np.uint16), np.array([2, 0, 1])).tolist() == [pseudo.EDGE] * 2 + [5, 6] + [pseudo.EDGE] * 4 + [7] + [pseudo.EDGE] * 2


def test_top_words(spark, monkeypatch):
    """The exact most frequent words, whatever is collected besides; also if very many share a count."""
    monkeypatch.setattr(pseudo, "KNOWN", 100)
    monkeypatch.setattr(pseudo, "FREQUENT", 30)
    rnd = np.random.default_rng(2)
    for n in (rnd.zipf(1.3, 3000).clip(max=10**6), np.ones(3000, int), np.append(np.full(40, 9), np.ones(2000, int)), np.arange(1, 51)):
        rows = [(f"w{k}", int(c)) for k, c in enumerate(n)]
        want = sorted(rows, key=lambda r: (-r[1], r[0]))
        found = pseudo.top_words(spark.createDataFrame(rows, "word string, n long"))
        assert found[:30] == want[:30] and found == want[: len(found)] and len(found) <= 110


def test_keys_are_sparks(spark):
    words = ["a", "aaing", "été", "中国人民", "😀😀😀x", "ab"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    sizes = np.arange(1.0, pseudo.RARE + 1)
    rest = spark.createDataFrame([(k, [pseudo._key(w, pseudo._bucket(w))]) for k, w in enumerate(words)], "text_key long, rest array<long>")
    found = {r["key"]: r["within"] for r in pseudo.rest_shares(rest, df, sizes).collect()}
    assert found == {k: pytest.approx(np.log(1.5 / sizes[pseudo._bucket(w)])) for k, w in enumerate(words)}


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    """The same documents in 1 and in 8 tasks, in another order and in small Arrow batches: the same scores."""
    monkeypatch.setattr(pseudo, "GROUP", 3000)
    monkeypatch.setattr(pseudo, "FAN", 3)
    monkeypatch.setattr(pseudo, "_HELD", 500)
    monkeypatch.setattr(pseudo, "_COUNTED", 50)
    texts = prose(400, seed=11) + ["", None, "again and again"] * 5
    rows = list(enumerate(texts)) + [(3, texts[3])] * 3
    found = []
    for parts, size, order in ((1, 10_000, 1), (8, 7, -1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(parts)
        counts = pseudo.count_words(docs)
        frequent, w = pseudo.train(docs, counts)
        found.append((frequent, w, sorted((r["doc_id"], r["sum_logprob"]) for r in pseudo.score(docs, frequent, w, counts).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0][0] == found[1][0] and all(np.array_equal(found[0][1][k], found[1][1][k]) for k in found[0][1])
    assert [a[0] for a in found[0][2]] == [b[0] for b in found[1][2]]
    assert np.allclose([a[1] for a in found[0][2]], [b[1] for b in found[1][2]], rtol=1e-6)


def test_rounds_go_on_from_the_average(spark, monkeypatch):
    """Two rounds over halves of the groups predict better than the first alone."""
    monkeypatch.setattr(pseudo, "GROUP", 4000)
    docs = spark.createDataFrame([(k, " ".join(sorted(t.split()))) for k, t in enumerate(prose(400, seed=7, vocabulary=60))], "doc_id long, text string")
    total = lambda: pseudo.score(docs, *pseudo.train(docs)).agg({"sum_logprob": "sum"}).first()[0]
    both = total()
    monkeypatch.setattr(pseudo, "ROUNDS", 1)
    assert both > total()


@pytest.mark.parametrize(("text", "letter"), [("½ ² ①", False), ("12 _ !", False), ("½a", True), ("中", True), ("é", True), ("", False)])
def test_letters(text, letter):
    assert language.has_letter(text) == letter
