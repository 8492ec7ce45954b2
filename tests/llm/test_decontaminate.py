import re

import pytest
from odd import edited, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from quillspark.llm import decontaminate as d
from quillspark.llm.common import written


def plain(text, width=5):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}


def wanted(text):
    """Shingles of an item: a short one has its whole word sequence."""
    n = len([w for w in re.split(r"[\W_]+", (text or "").lower()) if w])
    return plain(text, min(5, n)) if n else set()


def case(n=40):
    items = prose(12, seed=5, size=(12, 60), vocabulary=3000)
    items += [" ".join(items[0].split()[:4]), items[1].split()[3], "Two words!", " ".join(items[2].split()[:5]), "none of these", "", "?!"]
    base = prose(n, seed=6, size=(80, 400), vocabulary=3000)
    docs = []
    for k, text in enumerate(base):
        item = edited(items[k % 12], (k % 5) * 0.03, k) if k % 5 else items[k % 12].upper().replace(" ", ", ")
        docs.append(text if k % 3 == 0 else f"{text}\n{item} {text[:200]}")
    docs += [" ".join(items), "here are\ntwo, WORDS", "two", "", "words two"]  # many items in one text, and short texts
    half = items[0].split()
    docs.append(" ".join(half[: len(half) // 2]) + " break " + " ".join(half[len(half) // 2 :]))
    return docs, items


def test_hits_equal_brute_force(spark):
    docs, items = case()
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for share in (0.8, 0.5):
        found = {(r["doc_id"], r["item_id"]): (r["matched"], r["n_shingles"]) for r in d.contained(table, bench, share=share).collect()}
        want = {}
        for i, t in enumerate(docs):
            for j, q in enumerate(items):
                asked = wanted(q)
                has = plain(t, len(next(iter(asked)).split()) if asked else 5)
                if asked and len(has & asked) >= share * len(asked) - 1e-9:
                    want[i, j] = (len(has & asked), len(asked))
        assert found == want and len(want) > 20


def test_sketch_is_long_enough_for_its_partition(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(4 + n))) for k, n in enumerate(range(1, 40))] + [(-1, "one")], "item_id long, item_text string")
    made = d.sketches(items.select(F.struct("item_id", F.lit(0).alias("item_key")).alias("item"), "item_text")).groupBy("item.item_id").agg(F.count("*").alias("k"), F.max("need").alias("need")).collect()
    assert len(made) == 40
    for r in made:
        q = max(1, r["item_id"] + 1)
        missing = q - -(-8 * q // 10)
        assert r["k"] >= min(q, missing + 1) and r["need"] <= -(-8 * q // 10)


def test_shared_line_makes_few_candidates(spark, monkeypatch):
    """An instruction that all items and many documents share is looked for only where an item has little else."""
    line = " ".join(f"please{k}" for k in range(15))
    own = prose(300, seed=11, size=(30, 40), vocabulary=5000)
    items = [f"{line} {t}" for t in own]
    docs = [f"{line} {t}" for t in prose(300, seed=12, size=(30, 40), vocabulary=5000)] + items[:20]
    seen = {}
    monkeypatch.setattr(d, "written", lambda df, label: seen.setdefault(label, written(df, label)))
    found = d.contained(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(300 + k, k) for k in range(20)}
    assert seen["candidates"].count() <= 100


@pytest.mark.parametrize("most", [(0, 10**6), (0, 0)])
def test_large_sketches(spark, monkeypatch, most):
    """Beyond the broadcast bounds, the same hits."""
    monkeypatch.setattr(d, "BROADCAST_ROWS", most[0])
    monkeypatch.setattr(d, "BROADCAST_HASHES", most[1])
    test_hits_equal_brute_force(spark)


def test_plan_has_no_python(spark):
    docs, items = case(6)
    hits = d.contained(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    plan = hits._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "InArrow", "Cartesian", "NestedLoop"))


def test_odd_rows(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = odd_docs(spark).unionByName(odd_docs(spark, [None, item, f"before {item.lower()} after"]))
    docs = docs.unionByName(docs.where(F.col("text") == item).withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "not there", "x"), (None, item, "x")], "item_id long, text string, hash string")
    hits = d.contained(docs, bench).select("doc_id", "item_id").distinct().collect()
    assert {tuple(h) for h in hits} == {(i, j) for i in (1, 2, None) for j in (1, None)}
    assert d.contained(docs, bench.where("item_id IN (2, 3)")).collect() == []
    left = d.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 4  # row 2 is there twice
    assert d.decontaminate(docs, bench.where("1 = 0")).count() == docs.count()
    assert d.decontaminate(no_docs(spark), bench).count() == 0
