import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import edited, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from quillspark.llm import graph, simhash
from quillspark.llm.common import written
from quillspark.llm.graph import connected_components, forest, local_roots


CHOICES = simhash.choices


def plain_fingerprint(text, width):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes, radius):
    codes = np.array(codes, np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius
    a, b = np.nonzero(near)
    return local_roots(len(codes), a, b)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBc é\t\n\x0b\x85　", max_size=40))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text, 4) == plain_fingerprint(text, 4)


def test_fingerprint_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('a b c d') AS h").first()
    assert simhash.fingerprint("A b\tC d", 4) == row["h"] % 2**64


def test_bit_counts_beyond_one_lane():
    hashes = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    plain = [int(sum(int(h) >> b & 1 for h in hashes)) for b in range(64)]
    assert simhash.bit_counts(hashes).tolist() == plain


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 26, 27, 1000])
def test_lane_counts_are_plain_counts(n):
    lanes = np.random.default_rng(n).integers(0, 2**64, (5, n), np.uint64)
    plain = [[sum(int(h) >> b & 1 for h in row) for b in range(64)] for row in lanes]
    assert simhash.lane_counts(lanes).tolist() == plain


def test_wide_fingerprint_joins_its_blocks(monkeypatch):
    text = prose(1, size=(700, 700))[0]
    whole = simhash.wide_fingerprint(text, 5, 24)
    monkeypatch.setattr(simhash, "_BLOCK", 100)
    again = simhash.wide_fingerprint(text, 5, 24)
    assert whole[0] == again[0] > 100 and whole[1].tolist() == again[1].tolist()
    assert simhash.wide_fingerprint(" ", 5, 24)[1].tolist() == [0] * 24



@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("radius", [0, 2, 4])
def test_search_connects_what_brute_force_connects(seed, radius):
    rnd = random.Random(seed)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    codes = sorted({c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))) & (2**64 - 1) for c in seeds for _ in range(20)})
    codes = np.array(codes, np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    a, b = simhash.search(np.zeros(len(codes), np.int64), codes, radius, most=64)
    assert (np.bitwise_count(codes[a] ^ codes[b]) <= radius).all()
    assert (local_roots(len(codes), a, b) == plain_groups(codes, radius)).all()


def test_dense_group_makes_few_links():
    codes = np.array(sorted({(1 << 40) | k for k in range(4096)}), np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    a, b = simhash.search(np.zeros(len(codes), np.int64), codes, 12)
    assert len(a) <= 4 * len(codes) and len(set(local_roots(len(codes), a, b))) == 1


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


@pytest.mark.parametrize(("n", "radius", "bits"), [(10, 4, 64), (10**9, 4, 64), (10**11, 4, 64), (10**6, 2, 32), (10**9, 2, 32)])
def test_some_choice_of_blocks_agrees(n, radius, bits):
    """Whatever bits differ, up to the radius; and evenly spread codes fill no bucket."""
    masks = simhash.choices(n, radius, bits, 32_768)
    assert all(n >> m.bit_count() <= 32_768 for m in masks) and len(masks) <= 70
    rnd = random.Random(n)
    for _ in range(2000):
        differ = sum(1 << b for b in rnd.sample(range(bits), radius))
        assert any(not m & differ for m in masks)


@pytest.mark.parametrize("bucket_rows", [1, 8, 32768])
def test_groups_equal_brute_force(spark, bucket_rows, monkeypatch):
    if bucket_rows == 1:  # as if there were very many
        monkeypatch.setattr(simhash, "choices", lambda n, radius, bits, rows: CHOICES(10**10, radius, bits, 32_768))
    base = prose(30, size=(60, 200))
    texts = base + base[:5] + [edited(t, 0.02, k) for k, t in enumerate(base)] + [None, "", "solo", "Solo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in simhash.simhash_groups(docs, bucket_rows=bucket_rows).collect()}
    codes = [plain_fingerprint(t, 4) for t in texts]
    assert [found[k]["fp"] % 2**64 for k in range(len(texts))] == codes
    assert [found[k]["component_id"] for k in range(len(texts))] == plain_groups(codes, 4).tolist()


def test_odd_rows(spark):
    docs = odd_docs(spark)
    found = simhash.simhash_groups(docs).collect()
    assert len(found) == docs.count()
    zero = {r["component_id"] for r in found if r["fp"] == 0}
    assert zero == {0}  # null, empty and blank texts link with each other; the null id too
    assert {r["component_id"] for r in found if r["doc_id"] in (5, 90)} == {5}
    assert simhash.simhash_groups(no_docs(spark)).collect() == []


def test_rows_of_the_same_id_and_text(spark):
    """Of rows that differ in other columns only, the same one stays in any order."""
    rows = [(1, "one two three four five six", c, k) for k, c in enumerate("cab")] + [(2, None, "x", 1), (2, None, "w", 2)]
    for order in (1, -1):
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string, lang string, row long").repartition(3)
        assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(1, rows[0][1], "a", 1), (2, None, "w", 2)]


def jaccard(a, b, width=5):
    cut = lambda t: {tuple(t.lower().split()[k : k + width]) for k in range(max(1, len(t.split()) - width + 1))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_keep_one_of_each_group(spark):
    base = prose(60, seed=3, size=(150, 300))
    near = [edited(t, 0.01, k) for k, t in enumerate(base[:30])]
    far = [edited(t, 0.15, k) for k, t in enumerate(base[30:])]
    assert min(jaccard(a, b) for a, b in zip(base, near)) >= 0.85 and max(jaccard(a, b) for a, b in zip(base[30:], far)) < 0.6
    texts = base + near + far + base[:3]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(60), *range(90, 120)]


def test_keep_one_odd_rows(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id here at all"]
    assert simhash.keep_one(no_docs(spark)).collect() == []


@pytest.mark.parametrize("step", [1, 7919])
def test_components_of_a_long_path(spark, step, monkeypatch):
    """A path of 1,000 links, numbered in order or scrambled, takes few rounds and plans stay short."""
    made = []
    monkeypatch.setattr(graph, "written", lambda df, label: made.append(label) or written(df, label))
    links = spark.range(1000).select(((F.col("id") * step) % 1009).alias("a"), (((F.col("id") + 1) * step) % 1009).alias("b"))
    roots = connected_components(links, few=0)
    assert made.count("links") - 1 <= 12
    assert str(roots._jdf.queryExecution().optimizedPlan()).count("Join") == 1
    rows = roots.collect()
    ids = [k * step % 1009 for k in range(1001)]
    assert sorted(r["node"] for r in rows) == sorted(ids) and {r["root"] for r in rows} == {min(ids)}
    assert connected_components(links.where("1 = 0")).collect() == []


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_components_equal_brute_force(spark, few):
    rnd = np.random.default_rng(8)
    a, b = rnd.integers(0, 400, 260), rnd.integers(0, 400, 260)
    a[:60], b[:60] = 7, np.arange(300, 360)  # a hub
    links = spark.createDataFrame([(int(x) - 200, int(y) - 200) for x, y in zip(a, b)] + [(None, 3), (4, None), (150, 150)], "a long, b long")
    want = local_roots(400, a, b)
    own = {int(x) for x, y in zip(a, b) if x != y} | {int(y) for x, y in zip(a, b) if x != y}
    found = {r["node"]: r["root"] for r in connected_components(links, few).collect()}
    assert found == {k - 200: int(want[k]) - 200 for k in own}


def test_forest_takes_cheap_links():
    a, b, cost = np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4]), np.array([5, 1, 1, 2])
    assert sorted(forest(5, a, b, cost).tolist()) == [1, 2, 3]


def test_keep_one_in_a_family_below_the_threshold(spark):
    """Texts on one template, alike to less than 0.8, with near copies of 0.8 or more among them."""
    rnd = random.Random(5)
    head = " ".join(f"common{k}" for k in range(180))
    own = [f"{head} " + " ".join(f"w{rnd.randrange(10**9)}" for _ in range(40)) for _ in range(2000)]
    near = [edited(t, 0.015, k) for k, t in enumerate(own[:300])]
    assert max(jaccard(own[0], t) for t in own[1:50]) < 0.8 and min(jaccard(a, b) for a, b in zip(own, near)) >= 0.8
    docs = spark.createDataFrame(list(enumerate(own + near)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == list(range(2000))


def test_short_texts_are_compared_on_their_sets(spark):
    """Nine words and their first eight (0.8) are copies; two texts with 7 of 9 shingles in common are not."""
    words = [f"w{k}" for k in range(100_000)]
    nine = [" ".join(words[20 * k : 20 * k + 9]) for k in range(500)]
    twelve = [" ".join(words[20_000 + 20 * k : 20_012 + 20 * k]) for k in range(500)]
    copies = [t.rsplit(" ", 1)[0] for t in nine]
    others = [f"{t.rsplit(' ', 1)[0]} other{k}" for k, t in enumerate(twelve)]
    assert jaccard(nine[0], copies[0]) == 0.8 and jaccard(twelve[0], others[0]) == 7 / 9
    docs = spark.createDataFrame(list(enumerate(nine + twelve + copies + others)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {*range(1000), *range(1500, 2000)}


@pytest.mark.parametrize("n", [1, 10**5, 3 * 10**6, 10**8])
def test_keys_keep_buckets_small_and_meet(n):
    """However many fingerprints there are, a bucket has few unlike ones, and pairs at the threshold meet."""
    width, number = simhash.key_plan(n, 0.8)
    assert n / 2**width <= simhash.KEY_ROWS
    pieces = [simhash.key_windows(k, width) for k in range(number)]
    bits = [np.concatenate([np.arange(at, at + m) for at, m in key]) for key in pieces]
    assert all(len(set(b)) == width and max(b) < 64 * simhash.PARTS for b in bits) and len({tuple(b) for b in bits}) == number
    differ = np.random.default_rng(n).random((8000, 64 * simhash.PARTS)) < np.arccos(8 / 9) / np.pi
    met = np.zeros(len(differ), bool)
    for b in bits:
        met |= ~differ[:, b].any(axis=1)
    assert met.mean() >= 0.995


@pytest.mark.parametrize("bucket_rows", [8, 32768])
def test_clusters_hold_the_near_pairs(spark, bucket_rows):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2, (40, 128))
    bits = np.repeat(base, 5, axis=0) ^ (rnd.random((200, 128)) < 0.06)
    checks = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
    block = [*(k // 50 for k in range(190)), *range(100, 110)]  # the last ten are alone
    rows = [(b, b // 2, k, int(x), int(y), k) for k, (b, (x, y)) in enumerate(zip(block, checks, strict=True))]
    codes = spark.createDataFrame(rows, "block long, coarse long, node long, c1 long, c2 long, grp long")
    met = simhash.near_clusters(codes, 20, 40, bucket_rows).toPandas().groupby("cluster")["node"].apply(set).tolist()
    far = (bits[:, None] != bits[None]).sum(axis=2)
    near = [(a, b) for a in range(200) for b in range(a) if block[a] == block[b] and far[a, b] <= 40 and (bits[a, :64] != bits[b, :64]).sum() <= 20]
    assert len(near) >= 300 and all(any({a, b} <= c for c in met) for a, b in near)
    assert max(map(len, met)) <= 5
    assert simhash.near_clusters(codes.where("block >= 100"), 20, 40).collect() == []
