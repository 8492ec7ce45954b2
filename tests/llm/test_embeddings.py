import numpy as np
import pandas as pd
import pytest

from quillspark.llm import embeddings as e
from quillspark.llm.common import tiled
from quillspark.llm.graph import local_roots


def plain(vectors):
    """Links and components by all pairs, from (id, vector) rows."""
    ok = [k for k, (i, v) in enumerate(vectors) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [vectors[k][0] for k in ok]
    n = len(ok)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            x, y = np.array(vectors[ok[a]][1], float), np.array(vectors[ok[b]][1], float)
            if ids[a] != ids[b] and len(x) == len(y):
                near[a, b] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9
    root = local_roots(n, *np.nonzero(near))
    least = {r: min(ids[k] for k in range(n) if root[k] == r) for r in root}
    links = {ids[k]: len({ids[j] for j in range(n) if near[k, j]}) for k in range(n)}
    return {i: (links[i], least[root[k]]) for k, i in enumerate(ids)}


def cloud(n, seed, size=16, spread=0.12):
    random = np.random.default_rng(seed)
    middles = random.standard_normal((n // 6 + 1, size))
    return [(middles[k % len(middles)] + spread * random.standard_normal(size) * (k % 4)).astype(np.float32).tolist() for k in range(n)]


@pytest.mark.parametrize("leaf", [1024, 24])
def test_links_equal_brute_force(spark, leaf):
    vectors = list(enumerate(cloud(400, 1)))
    vectors += [(1000 + k, v) for k, (_, v) in enumerate(vectors[:40])]  # equal ones
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_vectors(table, leaf=leaf, trees=16).collect()}
    want = plain(vectors)
    total = sum(n for n, _ in want.values())
    assert total > 1000 and sum(n for n, _ in found.values()) >= 0.99 * total
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(found[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_large_leaves_are_split_on(spark):
    """Trees fitted on a small sample, then several rounds of further splits."""
    vectors = list(enumerate(cloud(1500, 4)))
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = e.near_vectors(table, leaf=24, trees=16, sample=40, leaf_sample=64).collect()
    x = e.unit(np.array([v for _, v in vectors]))
    near = x @ x.T >= 0.9
    want = near.sum() - len(x)
    links = {r["vec_id"]: r["n_links"] for r in found}
    assert sorted(links) == list(range(1500)) and 0.98 * want <= sum(links.values()) <= want
    assert all(links[k] < near[k].sum() for k in links)


def test_split_on_leaves_small_leaves(spark):
    random = np.random.default_rng(5)
    rows = [(v.tolist(), k, 1, [7, 9] if k % 2 else [7]) for k, v in enumerate(random.standard_normal((1200, 12)).astype(np.float32))]
    routed = spark.createDataFrame(rows, "vector array<float>, node long, copies long, leaves array<long>")
    out = e.split_on(routed, 0.9, 100, 128).toPandas()
    sizes = out.explode("leaves").groupby("leaves").size()
    assert len(out) == 1200 and out["leaves"].map(len).min() >= 1
    assert sizes.max() <= 200 and 7 not in sizes.index and 9 not in sizes.index


def test_half_dense_group_does_not_multiply():
    """A group of which the band holds most: without the bound each level would double it."""
    random = np.random.default_rng(6)
    x = e.unit(np.ones(32) + 0.2 * random.standard_normal((4000, 32)))
    tree = e.grow(x, 1.0, 0.9, 64, 0)
    assert sum(len(rows) for _, rows in e.descend(tree, x, e._band(0.9, 32), 0)) <= 40 * len(x)


def test_dense_group_is_compared_in_tiles(spark):
    random = np.random.default_rng(2)
    middle = random.standard_normal(16)
    vectors = [(k, (middle + 0.02 * random.standard_normal(16)).astype(np.float32).tolist()) for k in range(150)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    rows = e.near_vectors(table, leaf=20, trees=3).collect()
    assert {(r["n_links"], r["component_id"]) for r in rows} == {(149, 0)} and sum(r["kept"] for r in rows) == 1


def test_odd_vectors(spark):
    one, two = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    vectors = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]), (7, one), (8, two), (9, [2.0, 0.0, 1.0]), (7, one), (None, one), (10, one[:2]), (11, [1e300, 0.0, 5e299]), (12, [-1.0, 0.0, -0.5])]
    table = spark.createDataFrame([(i, v, 1, 1.0) for i, v in vectors], "vec_id long, embedding array<double>, node int, links double")
    rows = e.near_vectors(table).collect()
    assert len(rows) == len(vectors)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert found[7] == (3, 7, True) and found[8] == (3, 7, False) and found[9] == (3, 7, False) and found[11] == (3, 7, False)
    assert found[None] == (0, None, False)
    assert all(found[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 12))
    assert e.near_vectors(table.where("1 = 0")).collect() == []


def test_number_of_trees():
    """Grows with the input beyond the least number; a pair's chance of being parted is that of a simulation."""
    assert e.trees_for(0) == e.trees_for(1000) == e.trees_for(200_000) == e.TREES < e.trees_for(10**7) < e.trees_for(10**9) < 100
    random = np.random.default_rng(3)
    u, band = random.standard_normal(10**6), e.SPILL * np.sqrt(0.2)
    v = 0.9 * u + np.sqrt(0.19) * random.standard_normal(10**6)
    parted, share = 2 * ((u < -band) & (v > band)).mean(), (u <= band).mean()
    kept = (1 - parted) ** (np.log(10**9 / e.LEAF) / -np.log(share))
    assert e.trees_for(10**9) == pytest.approx(np.log(e.MISSED) / np.log(1 - kept), rel=0.03)


def test_recall_and_growth_at_two_sizes(spark, monkeypatch):
    """Links against brute force over 4,000 and 16,000 vectors; copies of a vector grow slowly."""
    copies = {}
    for n in (4_000, 16_000):
        vectors = cloud(n, n, size=24, spread=0.09)
        x = e.unit(np.array(vectors))
        want = sum(int((x[k : k + 1000] @ x.T >= 0.9).sum()) for k in range(0, n, 1000)) - n
        seen = []
        monkeypatch.setattr(e, "tiled", lambda rows, *a: seen.append(rows) or tiled(rows, *a))
        table = spark.createDataFrame(pd.DataFrame({"vec_id": range(n), "embedding": vectors}), "vec_id long, embedding array<float>")
        found = e.near_vectors(table, leaf=128, sample=2_000).agg({"n_links": "sum"}).first()[0]
        assert want > n and 0.99 * want <= found <= want
        copies[n] = seen[0].count() / n
    assert copies[16_000] < 1.25 * copies[4_000]


def test_lengths_that_the_sample_lacks(spark):
    vectors = cloud(3_000, 9, size=12) + cloud(30, 10, size=7)
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r["n_links"] for r in e.near_vectors(table, leaf=16, sample=20, leaf_sample=64).collect()}
    x = e.unit(np.array(vectors[3_000:]))
    assert [found[3_000 + k] for k in range(30)] == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()
