"""Search against a plain scorer, the index's rules, growth and corruption."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import html, text
from quillspark.operators import cards, index, search
from quillspark.sources.place import fresh_dir
from tests_util import plain_tokens

TEXTS = {
    "1": "他的書車壞了，書車真舊", "2": "书车修理 bicycle repair", "3": "Walking slowly; walkng slowly walking", "4": "an old grey train", "5": "An olt gray trains",
    "6": "", "7": "國語學校 grammar Grammar", "8": "朋友 dear friend", "9": "baking baking Baking", "10": "crème 奶油", "11": "關門 outside", "12": None,
}
QUERIES = ["书车", "書車", "walking", "walkng", "grey train", "an old", "國語", "baking", "dear frend", "grammar", "关门", "nothinglikeit", "walking walking", "crème", "", "，", "train 书", "a"]


def table(spark, texts=None):
    return spark.createDataFrame(list((TEXTS if texts is None else texts).items()), "uri string, content string")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def plain_search(texts, query, folds):
    cut = {u: plain_tokens(t or "", folds) for u, t in texts.items()}
    freq = {u: {} for u in cut}
    for u, ts in cut.items():
        for t in ts:
            freq[u][t.lower()] = freq[u].get(t.lower(), 0) + 1
    length = {u: len(set(ts)) for u, ts in cut.items()}
    n, mean = len(cut), sum(length.values()) / len(cut)
    names = {t for f in freq.values() for t in f}
    asked = [t.lower() for t in plain_tokens(query, folds)]
    result = None
    for q in asked:
        hits = {}
        plain = not html._ALL_CJK.fullmatch(q)
        most = min(4, math.floor(len(q.encode("utf-16-le")) / 2 * 0.35 + 0.5)) if plain else 0
        for t in names:
            d = 0 if t == q else distance(t, q) if most and not html._ALL_CJK.fullmatch(t) else 99
            if d > most:
                continue
            size = len(t.encode("utf-16-le")) / 2
            weight = 1 if d == 0 else 0.45 * size / (size + d)
            df = sum(t in f for f in freq.values())
            for u, f in freq.items():
                if t in f:
                    one = math.log(1 + (n - df + 0.5) / (df + 0.5)) * (0.5 + f[t] * 2.2 / (f[t] + 1.2 * (0.3 + 0.7 * length[u] / mean)))
                    s, ts = hits.get(u, (0, set()))
                    hits[u] = (s + weight * one, ts | {t})
        result = hits if result is None else {u: (result[u][0] + s, result[u][1] | ts) for u, (s, ts) in hits.items() if u in result}
    return {u: (round(s * len(set(asked)), 6), sorted(ts)) for u, (s, ts) in (result or {}).items()}


@pytest.fixture(scope="module")
def built(spark):
    return index.save(index.build(table(spark)), fresh_dir(spark, "index"))


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_plain(spark, built, query):
    found = {r["uri"]: (round(r["score"], 6), r["terms"]) for r in search.search(built, query).collect()}
    assert found == plain_search(TEXTS, query, str.maketrans(*text.folding()))


def test_random_texts(spark):
    rnd = random.Random(8)
    names = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts = {str(k): " ".join(rnd.choice(names) for _ in range(rnd.randint(0, 30))) for k in range(60)}
    built = index.build(table(spark, texts))
    for query in (names[0], f"{names[1]} {names[2]}"):
        found = {r["uri"]: (round(r["score"], 6), r["terms"]) for r in search.search(built, query).collect()}
        assert found == plain_search(texts, query, {})


def test_empty_index(spark):
    built = index.build(table(spark).where("1 = 0"))
    assert search.search(built, "the").collect() == [] and built.stats() == (0, 0.0)


def content(built):
    return [sorted(map(tuple, t.collect())) for t in (built.docs.select("uri", "field_length"), built.terms.select("term", "df", "is_cjk", "len"), built.postings.select("term", "uri", "tf"), built.meta)]


def test_growth_equals_a_rebuild(spark, built):
    half = index.build(table(spark).where("uri < '3'"))
    grown = index.grow(half, table(spark).unionByName(table(spark)))
    assert content(grown) == content(built) == content(index.grow(None, table(spark)))
    assert content(index.grow(built, table(spark))) == content(built)


def test_stored_versions(spark, built):
    base = fresh_dir(spark, "index")
    assert index.load(spark, base) is None and not index.usable(None, 0)
    first = index.load_or_build(spark, base, table(spark))
    assert content(first) == content(built) and index.usable(first, 12) and not index.usable(first, 11)
    more = table(spark, TEXTS | {"13": "new words"})
    assert index.load_or_build(spark, base, more).stats()[0] == 13
    index.clear(spark, base)
    assert index.load(spark, base) is None


BROKEN = {
    "orphan_posting": lambda ix: index.Index(ix.docs.where("uri <> '2'"), ix.terms, ix.postings, ix.meta),
    "df_differs": lambda ix: index.Index(ix.docs, ix.terms.withColumn("df", F.col("df") + 1), ix.postings, ix.meta),
    "empty_term": lambda ix: index.Index(ix.docs, ix.terms.withColumn("term", F.lit("")), ix.postings, ix.meta),
    "document_count_differs": lambda ix: index.Index(ix.docs, ix.terms, ix.postings, ix.meta.withColumn("document_count", F.lit(99))),
    "repeated_posting": lambda ix: index.Index(ix.docs, ix.terms, ix.postings.union(ix.postings), ix.meta),
    "repeated_document": lambda ix: index.Index(ix.docs.union(ix.docs), ix.terms, ix.postings, ix.meta),
    "frequency_below_one": lambda ix: index.Index(ix.docs, ix.terms, ix.postings.withColumn("tf", F.lit(0)), ix.meta),
    "flag_differs": lambda ix: index.Index(ix.docs, ix.terms.withColumn("is_cjk", ~F.col("is_cjk")), ix.postings, ix.meta),
}


@pytest.mark.parametrize("rule", BROKEN)
def test_corruption_is_seen(built, rule):
    found = {r["rule"]: r["n"] for r in index.violations(BROKEN[rule](built)).collect()}
    assert found[rule] > 0


def test_sound_index_breaks_no_rule(built):
    assert {r["n"] for r in index.violations(built).collect()} == {0}


def test_orders_and_types(spark):
    hits = spark.createDataFrame([("a", 1.0, "2024-01-02", ["post"]), ("b", 2.0, "2024-01-01", ["favourite"]), ("c", 2.0, "2024-01-03", ["boost", "bookmark"])], "uri string, score double, created_at string, types array<string>")
    by = lambda k: "".join(r["uri"] for r in search.ordered(hits, k).collect())
    assert (by("relevance"), by("newest"), by("oldest")) == ("bca", "cab", "bac")
    assert {r["uri"]: r["rank"] for r in search.ranked(hits, "newest").collect()} == {"c": 1, "a": 2, "b": 3}
    assert {r["uri"] for r in search.with_types(hits).collect()} == {"a", "c"}
    assert search.with_types(hits, ()).collect() == []


def test_searchable_content_and_cards(spark):
    media = "array<struct<type:string,url:string,preview_url:string,description:string>>"
    rows = [("u1", "<p>body</p>", "2024-01-01T00:00:00Z", "ann", "1", None, "warned", [("image", "", "p", "alt text"), ("image", "m", "p", None)], ["post", "other"]), ("u2", "plain", "x", "bob@host", "2", "https://l", "", None, ["favourite"])]
    stored = spark.createDataFrame(rows, f"uri string, content string, created_at string, acct string, id string, url string, spoiler_text string, media {media}, types array<string>")
    assert {tuple(r) for r in cards.index_docs(stored).collect()} == {("u1", "body warned alt text"), ("u2", "plain")}
    hits = spark.createDataFrame([("u1", 1.0, ["body"]), ("u2", 0.5, ["plain"])], search.HITS)
    authors = spark.createDataFrame([("ann", "Ann", "pic", "https://p")], "acct string, display_name string, avatar string, url string")
    shown = {r["uri"]: r for r in cards.cards(hits, stored, authors, F.lit("https://i"), F.lit("2024-01-01 00:05:00").cast("timestamp")).collect()}
    one, two = shown["u1"], shown["u2"]
    assert (one["display_name"], one["initial"], one["avatar"], one["link"], one["profile"], one["badges"], one["time"]) == ("Ann", "A", "pic", "https://i/@ann/1", "https://p", ["原創"], "5 分鐘前")
    assert one["content"] == "<p><mark>body</mark></p>" and [m["link"] for m in one["media"]] == ["https://i/@ann/1", "m"]
    assert (two["display_name"], two["initial"], two["avatar"], two["link"], two["profile"], two["time"], two["time_title"], two["media"]) == ("bob@host", "B", "", "https://l", "https://i/@bob@host", "", "", [])


def test_nfkc(spark):
    assert unicodedata.normalize("NFKC", "ﬁ２") == spark.createDataFrame([("ﬁ２",)], "t string").select(text.nfkc("t")).first()[0]
